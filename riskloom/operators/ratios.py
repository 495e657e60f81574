"""Financial ratios (D1-D13) and the sequential 5-sigma outlier filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..session import staged

# The 12 ratio names in the reference's processing order (D14 is
# order-sensitive, so this order matters).
RATIO_COLS = [
    "roa", "roe", "profit_margin", "revenue_growth",
    "current_ratio", "quick_ratio", "debt_to_equity", "debt_to_asset",
    "asset_turnover", "inventory_turnover", "receivable_turnover", "dscr",
]
KEY_COLS = ["ticker", "company_name", "year", "industry_code"]
FIRST_YEAR_GROWTH = 0.10


def ratio_columns() -> dict:
    """D1-D3, D5-D12 as Column expressions over a statement row (zero denominator -> NULL)."""
    c = F.col
    return {
        "roa": safe_div(c("net_income"), c("total_assets")),
        "roe": safe_div(c("net_income"), c("equity")),
        "profit_margin": safe_div(c("net_income"), c("revenue")),
        "current_ratio": safe_div(c("current_assets"), c("current_liabilities")),
        "quick_ratio": safe_div(c("current_assets") - c("inventory"), c("current_liabilities")),
        "debt_to_equity": safe_div(c("total_debt"), c("equity")),
        "debt_to_asset": safe_div(c("total_debt"), c("total_assets")),
        "asset_turnover": safe_div(c("revenue"), c("total_assets")),
        "inventory_turnover": safe_div(c("cogs"), c("inventory")),
        "receivable_turnover": safe_div(c("revenue"), c("receivables")),
        "dscr": safe_div(c("net_income") * 1.5, c("total_debt") * 0.15 + 1),
    }


def revenue_growth(key: str = "ticker", order: str = "year", value: str = "revenue",
                   first: float = FIRST_YEAR_GROWTH):
    """Per-key ``pct_change`` ordered by year; first row -> ``first``.

    pandas pads a NULL value forward before differencing, so the previous non-null value
    is taken with ``last(ignorenulls)``. A zero previous value gives NULL (pandas: inf).
    The window partitions by company, so each task holds one company's few years.
    """
    w = Window.partitionBy(key).orderBy(order)
    padded = F.last(F.col(value), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return padded, w


def calculate_ratios(raw: DataFrame, keep_raw: bool = True) -> DataFrame:
    """All 12 ratios in one projection plus one per-company window."""
    exprs = ratio_columns()
    padded, w = revenue_growth()
    df = raw.withColumn("_rev_pad", padded)
    prev = F.lag("_rev_pad").over(w)
    # 0 after 0 is undefined, like a first year, and takes the same fill; anything else after 0 is NULL
    growth = (F.when(prev.isNull() | ((prev == 0) & (F.col("_rev_pad") == 0)), F.lit(FIRST_YEAR_GROWTH))
              .otherwise(safe_div(F.col("_rev_pad"), prev) - 1))
    base = raw.columns if keep_raw else KEY_COLS
    out = df.select(*base, *[exprs[r].alias(r) if r != "revenue_growth" else growth.alias(r)
                             for r in RATIO_COLS])
    return out


def financial_features(raw: DataFrame) -> DataFrame:
    """The 16-column ``financial_features`` projection (keys + 12 ratios)."""
    return calculate_ratios(raw, keep_raw=False)


#: A row is in the tail if a ratio is further than this part of the bound's width from the mean.
TAIL_SHARE = 0.5


def _moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[int, float, float]]:
    """count, mean and sum of squared deviations of each column, from one pass."""
    row = df.agg(*(e for c in cols for e in (F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}")))).first()
    return {c: (row[f"n_{c}"], row[f"m_{c}"] or 0.0, (row[f"v_{c}"] or 0.0) * row[f"n_{c}"]) for c in cols}


def _merged(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """Moments of two sets of rows together; no difference of large sums is taken."""
    n = a[0] + b[0]
    if not n:
        return 0, 0.0, 0.0
    shift = b[1] - a[1]
    return n, a[1] + shift * b[0] / n, a[2] + b[2] + shift * shift * a[0] * b[0] / n


def _bounds(moments: tuple[int, float, float], k: float) -> tuple[float, float] | None:
    n, mean, squares = moments
    if n < 2:
        return None
    width = k * (squares / (n - 1)) ** 0.5
    return mean - width, mean + width


def outlier_bounds(df: DataFrame, ratio_cols: Sequence[str] = tuple(RATIO_COLS), k: float = 5.0) -> list[tuple[str, float, float] | None]:
    """The bounds of each ratio in order, from the rows that the earlier ones leave (None: too few rows).

    Pass 1 takes all ratios' moments. Pass 2 writes the rows of the tail (a ratio is NULL or further from its mean than ``TAIL_SHARE``
    of the bound) and one row with the moments of all others, the core. Each ratio's survivors are then the core and the
    rows of the tail that are left, whose moments are added. That holds as long as no bound cuts into the core;
    where one does, as after the removal of extreme values, the two passes are taken again from there.
    """
    cols, found, now = list(ratio_cols), [], df
    while cols:
        means = _moments(now, cols)
        cut = {c: _bounds(means[c], k * TAIL_SHARE) for c in cols}
        inner = F.lit(True)
        for c in cols:
            inner &= F.lit(False) if cut[c] is None else F.coalesce((F.col(c) >= cut[c][0]) & (F.col(c) <= cut[c][1]), F.lit(False))
        apart = F.when(~inner, F.monotonically_increasing_id())  # NULL: the core, one group
        parts = staged(now.select(*cols, apart.alias("_row")).groupBy("_row").agg(*(e for c in cols for e in (F.count(c).alias(f"n_{c}"), F.avg(c).alias(c), F.var_pop(c).alias(f"v_{c}")))), "tail")
        core = parts.filter("_row is null").first()
        core = {c: (core[f"n_{c}"], core[c], core[f"v_{c}"] * core[f"n_{c}"]) if core else (0, 0.0, 0.0) for c in cols}
        tail = parts.filter("_row is not null").select(*cols)
        for c in list(cols):
            bounds = _bounds(_merged(core[c], _moments(tail, [c])[c]), k)
            cols.remove(c)
            if bounds is None:
                return [*found, None]
            found.append((c, *bounds))
            tail, now = tail.filter(F.col(c).between(*bounds)), now.filter(F.col(c).between(*bounds))
            if core[c][0] and (bounds[0] > cut[c][0] or bounds[1] < cut[c][1]):
                break  # these bounds are exact, but the core is no longer whole
    return found


def remove_outliers(df: DataFrame, ratio_cols: Sequence[str] = tuple(RATIO_COLS), k: float = 5.0) -> DataFrame:
    """D14 (T15): for each ratio *in order*, keep mean +- k * sample-std of the survivors.

    Sequential by definition: step i's mean/std are computed on the rows surviving
    steps < i. The bounds become literals, so the returned plan is one chain of filters over the
    input. Rows with a NULL ratio fail the comparison and drop, exactly like a pandas boolean mask; if a
    step has fewer than two rows to take a std of, no row survives. ``df`` is read about twice: pass a table.
    """
    out = df
    for found in outlier_bounds(df, ratio_cols, k):
        # pandas: NaN bounds -> every comparison is False -> no row survives.
        out = out.filter(F.lit(False)) if found is None else out.filter(F.col(found[0]).between(found[1], found[2]))
    return out


def remove_outliers_single_pass(df: DataFrame, ratio_cols: Sequence[str] = tuple(RATIO_COLS),
                                k: float = 5.0) -> DataFrame:
    """Variant: all bounds from the *unfiltered* input in one fused aggregate pass."""
    aggs = []
    for c in ratio_cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}")]
    stats = df.agg(*aggs)
    cond = F.lit(True)
    for c in ratio_cols:
        m, s = F.col(f"m_{c}"), F.col(f"s_{c}")
        cond = cond & (F.col(c) >= m - k * s) & (F.col(c) <= m + k * s)
    # The stats side is one row by construction: a broadcast of a proven-size frame.
    return df.crossJoin(F.broadcast(stats)).filter(cond).select(*df.columns)


def industry_ratio_profile(features: DataFrame) -> DataFrame:
    """mean ratio profile per industry (records, roa, roe, margin, current ratio, D/E)."""
    return features.groupBy("industry_code").agg(
        F.count(F.lit(1)).alias("records"),
        F.avg("roa").alias("avg_roa"),
        F.avg("roe").alias("avg_roe"),
        F.avg("profit_margin").alias("avg_profit_margin"),
        F.avg("current_ratio").alias("avg_current_ratio"),
        F.avg("debt_to_equity").alias("avg_debt_to_equity"),
    )


def industry_raw_profile(raw: DataFrame) -> DataFrame:
    """F3 raw variant: company-years, avg revenue and avg total assets per industry."""
    return raw.groupBy("industry_code").agg(
        F.count(F.lit(1)).alias("records"),
        F.avg("revenue").alias("avg_revenue"),
        F.avg("total_assets").alias("avg_total_assets"),
    )


def panel_coverage(df: DataFrame) -> DataFrame:
    """distinct tickers and distinct years, plus first/last year."""
    return df.agg(
        F.countDistinct("ticker").alias("n_tickers"),
        F.countDistinct("year").alias("n_years"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.count(F.lit(1)).alias("n_rows"),
    )
