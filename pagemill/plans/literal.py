"""Small literal tables that a query and its SQL share: shapes that the test tables don't hold (boxes, grids, notes, charts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SQL = {"int": "integer", "bigint": "bigint", "double": "double", "string": "varchar", "boolean": "boolean", "array<string>": "varchar[]", "array<int>": "integer[]"}


def _text(x: object) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_text, x)) + "]"
    return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


class Literal:
    """Rows with a schema (``name type, ...``) as a DataFrame and as a common table expression."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.fields = [tuple(f.strip().split(" ", 1)) for f in schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        real = [kind == "double" for _, kind in self.fields]
        return spark.createDataFrame([tuple(float(x) if f and x is not None else x for x, f in zip(r, real)) for r in self.rows], self.schema)

    def cte(self, name: str) -> str:
        names = ", ".join(f"v{k}" for k in range(len(self.fields)))
        typed = ", ".join(f'v{k}::{_SQL[kind]} as "{field}"' for k, (field, kind) in enumerate(self.fields))
        rows = ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in self.rows)
        return f"{name} as (select {typed} from (values {rows}) as v({names}))"
