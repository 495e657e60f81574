"""Two-population comparison (E4, F19-F21): aggregate each side, reshape, equi-join.

Each side is reduced to one row per (industry) by a single wide aggregate before the
join, so the join only ever sees (groups x features) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profile import describe

DRIFT_RATIOS = ["roa", "current_ratio", "debt_to_equity"]
KEY_RATIOS = ["roa", "roe", "current_ratio", "debt_to_equity", "asset_turnover"]


def compare_populations(a: DataFrame, b: DataFrame, cols: Sequence[str],
                        group_cols: Sequence[str] = (),
                        stats: Sequence[str] = ("mean", "std", "min", "max")) -> DataFrame:
    """Stats of each population per (group, feature), joined side by side."""
    g = list(group_cols)
    da = describe(a, cols, stats, group_cols=g)
    db = describe(b, cols, stats, group_cols=g)
    da = da.select(*g, "feature", *[F.col(s).alias(f"{s}_a") for s in stats])
    db = db.select(*g, "feature", *[F.col(s).alias(f"{s}_b") for s in stats])
    return da.join(db, g + ["feature"])


def diff_pct(a: str = "mean_a", b: str = "mean_b"):
    """abs(b - a) / abs(a) * 100; a zero base gives NULL."""
    return F.try_divide(F.abs(F.col(b) - F.col(a)), F.abs(F.col(a))) * 100


def drift_check(real: DataFrame, synth: DataFrame, cols: Sequence[str] = tuple(DRIFT_RATIOS),
                by: str = "industry_code", limit_pct: float = 15.0) -> DataFrame:
    """per industry x ratio mean drift %, the industry max, and PASS if max < limit."""
    c = compare_populations(real, synth, cols, [by], stats=("mean",))
    c = c.withColumn("diff_pct", diff_pct())
    mx = F.max("diff_pct").over(Window.partitionBy(by))
    return (c.withColumn("max_diff_pct", mx)
            .withColumn("status", F.when(F.col("max_diff_pct") < limit_pct, "PASS").otherwise("FAIL")))


def summary_table(real: DataFrame, synth: DataFrame, cols: Sequence[str]) -> DataFrame:
    """per ratio mean, diff %, std, min, max of both populations + avg/max error."""
    c = compare_populations(real, synth, cols, (), stats=("mean", "std", "min", "max"))
    c = c.withColumn("diff_pct", diff_pct())
    w = Window.partitionBy()
    return (c.withColumn("avg_error_pct", F.avg("diff_pct").over(w))
            .withColumn("max_error_pct", F.max("diff_pct").over(w)))


def industry_key_ratios(real: DataFrame, synth: DataFrame, cols: Sequence[str] = tuple(KEY_RATIOS),
                        by: str = "industry_code") -> DataFrame:
    """per industry key-ratio means of both populations, diff %, group sizes."""
    c = compare_populations(real, synth, cols, [by], stats=("mean", "count"))
    c = c.withColumn("diff_pct", diff_pct())
    na = real.groupBy(by).agg(F.count(F.lit(1)).alias("n_a"))
    nb = synth.groupBy(by).agg(F.count(F.lit(1)).alias("n_b"))
    return c.join(na, by).join(nb, by).drop("count_a", "count_b")
