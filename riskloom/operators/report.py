"""Data-quality report (A11) as one tidy (section, metric, value) frame.

One pass over the split table counts everything by split and industry; the report is read off
those few rows. Duplicates are counted by digests (``duplicates.py``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from ..sources.contract import LABEL_COL
from .duplicates import count_duplicates
from .sampling import SPLIT_COL


def qa_report(split_df: DataFrame, label: str = LABEL_COL, by: str = "industry_code", drop_cols: tuple = ("clone_ord",)) -> DataFrame:
    """A11 of a table with a split column; ``drop_cols`` and the split are no columns of the data."""
    data = split_df.drop(SPLIT_COL, *[c for c in drop_cols if c in split_df.columns])
    missing = sum([F.sum(F.col(f"`{c}`").isNull().cast("long")) for c in data.columns], F.lit(0))
    cube = staged(split_df.groupBy(SPLIT_COL, by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("pos"), F.count(label).alias("labelled"),
                                                      missing.alias("missing")), "qa_cube")
    total = cube.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("labelled").alias("labelled"), F.sum("missing").alias("missing"))

    def rows(df: DataFrame, section: str, metric, value) -> DataFrame:
        return df.select(F.lit(section).alias("section"), (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"), value.cast("double").alias("value"))

    sizes = cube.groupBy(SPLIT_COL).agg(F.sum("n").alias("k")).crossJoin(F.broadcast(total.select("n")))  # one row
    industries = cube.groupBy(by).agg(F.sum("n").alias("k"))
    parts = [
        rows(total, "dataset", "rows", F.col("n")),
        rows(total, "dataset", "columns", F.lit(len(data.columns))),
        rows(total, "dataset", "default_rate_pct", F.try_divide(F.col("pos"), F.col("labelled")) * 100),
        rows(sizes, "splits", F.concat(F.col(SPLIT_COL), F.lit("_rows")), F.col("k")),
        rows(sizes, "splits", F.concat(F.col(SPLIT_COL), F.lit("_pct")), F.col("k") * 100.0 / F.col("n")),
        rows(total, "quality", "missing_values", F.col("missing")),
        rows(count_duplicates(data), "quality", "duplicates", F.col("duplicates")),
        rows(industries, "industry", F.concat(F.col(by).cast("string"), F.lit("_rows")), F.col("k")),
    ]
    return reduce(DataFrame.unionByName, parts)
