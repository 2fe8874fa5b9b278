"""All queries of the core with their SQL."""

from __future__ import annotations

from pagemill.plans import composite, delivery, grids, layout, more, phrases, records, titles
from pagemill.plans import queries as basic

FLAGSHIP = "document_report"


def queries() -> dict:
    return basic.QUERIES | more.QUERIES | composite.QUERIES | layout.QUERIES | grids.QUERIES | phrases.QUERIES | records.QUERIES | titles.QUERIES | delivery.QUERIES


def oracle_sql() -> dict[str, str]:
    return basic.SQL | more.SQL | composite.SQL | layout.SQL | grids.SQL | phrases.SQL | records.SQL | titles.SQL | delivery.SQL
