"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pagemill.llm import language, leaks, lookalike, pack, privacy, scanned, spam, split, truncation

_MODULES = (lookalike, language, scanned, truncation, privacy, split, pack, leaks, spam)


def queries() -> dict:
    return {name: getattr(m, name) for m in _MODULES for name in sorted(vars(m)) if name[:1] == "p" and name[1:2].isdigit() and callable(getattr(m, name))}


def oracle_sql() -> dict[str, str]:
    return {"p6_found": split.P6_FOUND_SQL, "p7_found": pack.P7_FOUND_SQL}
