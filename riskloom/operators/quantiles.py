"""Exact linear-interpolated quantiles by counting, in bounded memory.

``percentile`` keeps a map of all distinct values of a group in one task. Here a value is first put into
one of about 130,000 cells by sign and logarithm (32 to an octave, non-decreasing in the value), and one
aggregate counts the cells of all columns and groups, with the smallest and the largest value of each.
Running sums of the counts name the cells that hold a wanted rank; a cell whose smallest and largest value
agree has the answer. The others are cut into ``CUTS`` equal parts between these two and counted again,
which is over after two or three passes for most data and, since each pass divides the width by ``CUTS``,
after at most five for any. A task holds one entry for each column, group and cell that it meets, however many
rows or distinct values there are, and equal values, however many, are one entry.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

OCTAVE_CELLS = 32
CUTS = 65_536
#: Open cells are broadcast to the values up to this many (100 bytes each); beyond it Spark joins them.
BROADCAST_CELLS = 100_000


def first_cell(x: Column) -> Column:
    """A cell number that never falls as ``x`` rises: 0 for zero, else by sign and logarithm."""
    steps = F.floor((F.log2(F.abs(x)) + 1100) * OCTAVE_CELLS)
    return F.when(x == 0, F.lit(0).cast("long")).when(x > 0, steps).otherwise(-steps)


def _wanted(cells: DataFrame, by: list[str], start: Column, probs: Sequence[float], total: Column) -> DataFrame:
    """The cells that hold a wanted rank: by, i, lo, hi, before (rows below), ranks, total.

    cells: by, i, cell, n, lo, hi, and the columns that ``start`` (rows below the first cell) and ``total`` use.
    """
    below = F.sum("n").over(Window.partitionBy(*by, "i", "_range").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    counted = cells.withColumn("before", start + F.coalesce(below, F.lit(0))).withColumn("total", total)
    at = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*(f(a).cast("long") for a in at for f in (F.floor, F.ceil))))
    return (counted.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n"))))
            .filter(F.size("ranks") > 0).select(*by, "i", "lo", "hi", "before", "ranks", "total"))


def exact_quantiles(df: DataFrame, values: Mapping[str, Column], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by..., feature, n (values), q (array of the quantiles at ``probs``): a row for each group and feature with values.

    ``values``: feature name -> Column. NULL and NaN take no part; NULL group keys are groups. ``df`` is read two
    to five times: pass a table, or a checkpoint.
    """
    by, names = list(by), list(values)
    keys = [f"_k{j}" for j in range(len(by))]
    cells = [F.struct(F.lit(k).alias("i"), values[n].cast("double").alias("x")) for k, n in enumerate(names)]
    rows = (df.select(*(F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)), F.explode(F.array(*cells)).alias("v"))
            .select(*keys, "v.i", "v.x").filter("x is not null and not isnan(x)"))
    figures = (F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    counted = rows.groupBy(*keys, "i", first_cell(F.col("x")).alias("cell")).agg(*figures).withColumn("_range", F.lit(0))
    total = F.sum("n").over(Window.partitionBy(*keys, "i"))
    found = staged(_wanted(counted, keys, F.lit(0), probs, total), "cells")
    done = [found.filter("lo = hi")]
    still = found.filter("lo < hi")
    while n := still.count():
        ranges = still.select(*(F.col(k).alias(f"_r{k}") for k in keys), F.col("i").alias("_ri"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                              F.col("before").alias("_before"), F.col("total").alias("_total"))
        same = (F.col("i") == F.col("_ri")) & F.col("x").between(F.col("_lo"), F.col("_hi"))
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_r{k}"))
        part = F.least(F.floor((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CUTS), F.lit(CUTS - 1))
        cut = (rows.join(F.broadcast(ranges) if n <= BROADCAST_CELLS else ranges, same)
               .groupBy(*keys, "i", F.col("_lo").alias("_range"), "_before", "_total", part.alias("cell")).agg(*figures))
        found = staged(_wanted(cut, keys, F.col("_before"), probs, F.col("_total")), "cells")
        done.append(found.filter("lo = hi"))
        still = found.filter("lo < hi")
    at_rank = reduce(DataFrame.unionByName, done).select(*keys, "i", "total", F.explode("ranks").alias("rank"), F.col("lo").alias("value"))
    ranked = at_rank.groupBy(*keys, "i").agg(F.max("total").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # two ranks a quantile at most

    def quantile(p: float) -> Column:
        pos = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        return F.when(low == high, F.col("at")[low]).otherwise((high - pos) * F.col("at")[low] + (pos - low) * F.col("at")[high])

    feature = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)
    return ranked.select(*(F.col(k).alias(b) for k, b in zip(keys, by)), feature.alias("feature"), "n", F.array(*map(quantile, probs)).alias("q"))


def quantile_row(df: DataFrame, values: Mapping[str, Column], probs: Sequence[float]) -> DataFrame:
    """One row: feature -> its quantiles' array (NULL without values)."""
    found = exact_quantiles(df, values, probs)
    return found.agg(*(F.max(F.when(F.col("feature") == n, F.col("q"))).alias(n) for n in values))


def medians(df: DataFrame, values: Mapping[str, Column]) -> dict[str, float | None]:
    """Exact medians by feature, on the driver."""
    found = {r["feature"]: r["q"][0] for r in exact_quantiles(df, values, [0.5]).collect()}  # one row a feature
    return {n: found.get(n) for n in values}


def grouped_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """The most frequent non-null value of each column (of ties the smallest), by grouped counts: no task holds all values."""
    if not cols:
        return {}
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols))).alias("v")).select("v.*")
    counts = rows.filter("value is not null").groupBy("feature", "value").count()
    # smallest of the most frequent: the least of (-count, value)
    top = counts.groupBy("feature").agg(F.min(F.struct((-F.col("count")).alias("c"), "value")).alias("m"))
    found = {r["feature"]: r["m"]["value"] for r in top.collect()}  # one row a column
    return {c: found.get(c) for c in cols}
