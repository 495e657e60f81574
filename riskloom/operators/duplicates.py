"""Duplicate rows by digest (C1, F12): whole rows meet only where their digests repeat.

A row's digest is 128 bits of all its columns, NULLs told apart from values. Digests are counted (16 bytes a row
are shuffled, equal ones are combined before), and only rows whose digest occurs again are compared column by column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Repeated digests are broadcast up to this many (32 bytes each); beyond it Spark joins them.
BROADCAST_DIGESTS = 500_000


def row_digest(columns: list[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of all columns and of which of them are NULL."""
    values = [F.col(f"`{c}`") for c in columns]
    nulls = F.concat(*[v.isNull().cast("int").cast("string") for v in values])
    return F.xxhash64(nulls, *values), F.xxhash64(*reversed(values), nulls, F.lit(1))


def _apart(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose digest is theirs alone, rows whose digest occurs again)."""
    a, b = row_digest(df.columns)
    rows = df.withColumns({"_digest_a": a, "_digest_b": b})
    again = staged(rows.groupBy("_digest_a", "_digest_b").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "repeated_digests")
    again = F.broadcast(again) if again.count() <= BROADCAST_DIGESTS else again
    on = ["_digest_a", "_digest_b"]
    return rows.join(again, on, "left_anti").select(*df.columns), rows.join(again, on, "left_semi").select(*df.columns)


def distinct_rows(df: DataFrame) -> DataFrame:
    """``df`` without repeated rows (C1). ``df`` is read three times: pass a table."""
    alone, repeated = _apart(df)
    return alone.unionByName(repeated.dropDuplicates())


def count_duplicates(df: DataFrame) -> DataFrame:
    """One row, ``duplicates``: the rows beyond the first of their kind."""
    _, repeated = _apart(df)
    kinds = repeated.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_k"))
    return kinds.agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).cast("long").alias("duplicates"))
