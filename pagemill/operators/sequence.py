"""Operators over ordered lines: islands, as-of partners, notes after tables, mail lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(lines: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """(keys, first, last, n): runs of neighbouring rows whose ``flag`` holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = lines.withColumn("_island", F.sum((~F.col(flag)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where(F.col(flag)).groupBy(*keys, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_island")


def last_before(lines: DataFrame, keys: list[str], order: str, value: Column) -> Column:
    """The last value that isn't null among the rows before each row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def after_table(lines: DataFrame, keys: list[str], order: str, is_table: str, is_text: str, most: int = 40) -> DataFrame:
    """Text rows that follow a table, up to the next table and at most ``most`` rows: (keys, table_no, order)."""
    w = Window.partitionBy(*keys).orderBy(order)
    begins = (F.col(is_table) & ~F.coalesce(F.lag(is_table).over(w), F.lit(False))).cast("int")
    numbered = lines.withColumn("table_no", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    text = numbered.where((F.col("table_no") > 0) & F.col(is_text))
    return text.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "table_no").orderBy(order))).where(F.col("_k") <= most).drop("_k")


def notes(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Distinct notes of each key, white space aside; the first of equal notes stays, in order."""
    key = F.regexp_replace(text, "[ \\t\\n\\r\\x{3000}]+", "")
    first = rows.withColumn("_key", key).groupBy(*keys, "_key").agg(F.min_by(text, order).alias(text), F.min(order).alias(order))
    return first.drop("_key")


def is_mail_header(line: Column) -> Column:
    """Sender, recipient and subject lines of copied mail."""
    return line.rlike("^[ ]*(?:From|To|Cc|Subject|Sent|RE|FW|Fwd|Betreff|Von|An|Objet|De|寄件者|收件者|主旨|差出人|件名)[ ]?[:：]")


def drop_mail_lines(lines: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Without mail headers and without the line after one that only goes on (starts with a space)."""
    w = Window.partitionBy(*keys).orderBy(order)
    header = is_mail_header(F.col(text))
    goes_on = F.coalesce(F.lag(header).over(w), F.lit(False)) & F.col(text).rlike("^[ \\t]+[^ ]")
    return lines.withColumn("_drop", header | goes_on).where("not _drop").drop("_drop")
