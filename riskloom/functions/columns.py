"""Scalar Column helpers.

Everything here builds JVM-side expressions, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """``num / den`` with a zero or NULL denominator giving NULL (ANSI-safe, N8)."""
    return F.try_divide(col_of(num), col_of(den))


def clip(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """pandas ``clip``: NULL stays NULL."""
    x = col_of(c)
    out = x
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


def nan_to_null(c: str | Column) -> Column:
    """NaN / +-inf -> NULL, the form in which pandas NaN is carried here."""
    x = col_of(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def map_values(c: str | Column, mapping: Mapping, default=None) -> Column:
    """``Series.map(dict)`` as a literal map lookup."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    # try_element_at: a missing key is NULL under ANSI too.
    looked = F.try_element_at(F.create_map(*pairs), col_of(c)) if pairs else F.lit(None)
    return looked if default is None else F.coalesce(looked, F.lit(default))


def row_sample_std(cols: Iterable[str | Column]) -> Column:
    """Row-wise sample std (ddof=1) of a fixed list of columns."""
    xs = [col_of(c) for c in cols]
    n = len(xs)
    mean = sum(xs[1:], xs[0]) / F.lit(float(n))
    ss = sum([(x - mean) * (x - mean) for x in xs[1:]], (xs[0] - mean) * (xs[0] - mean))
    return F.sqrt(ss / F.lit(float(n - 1)))


APPROX_ACCURACY = 100_000


def approx_quantiles(c: str | Column, probs) -> Column:
    """Sketched quantiles, for callers that ask for them; ``operators.quantiles`` has the exact ones."""
    return F.percentile_approx(col_of(c), list(probs), APPROX_ACCURACY)


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson r over the rows where both sides are present; NULL where either is constant there.

    ``corr`` divides by zero on a constant side (an error under ANSI), and rounding noise can pass
    for variance; smallest = largest decides, and the centred sums come from one streaming pass.
    """
    x, y = col_of(x).cast("double"), col_of(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    r = nan_to_null(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    # least and greatest skip NULL: the clamp must not make a number of it
    return F.when(varied & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """``select_dtypes(include=number)`` over the schema."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in ex]


def round_half_up(c: str | Column, digits: int) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d`` in plain IEEE arithmetic.

    ``F.round`` rounds the shortest decimal *string* of a double, DuckDB rounds the
    binary value, so the two disagree on x.xxx5 ties; this form is bit-identical in both.
    """
    scale = float(10 ** digits)
    return (F.floor(col_of(c) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale))


def round_doubles(df: DataFrame, digits: int = 6, overrides: Mapping[str, int] | None = None) -> DataFrame:
    """Round every floating column (oracle hashing helper; NaN -> NULL first)."""
    overrides = dict(overrides or {})
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            d = overrides.get(f.name, digits)
            out.append(round_half_up(nan_to_null(f.name), d).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# Coefficients of Acklam's published inverse-normal approximation.
ACKLAM_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
ACKLAM_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
            3.754408661907416e+00]


def inverse_normal_cdf(p: str | Column) -> Column:
    """Standard normal quantile by Acklam's rational approximation (|rel err| < 1.2e-9).

    Pure Column maths so a Q-Q table (F25) never leaves the JVM.
    """
    a, b, c, d = ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D
    p = col_of(p)
    plow = 0.02425

    def poly(coefs, x):
        acc = F.lit(coefs[0])
        for k in coefs[1:]:
            acc = acc * x + F.lit(k)
        return acc

    q_lo = F.sqrt(-2 * F.log(p))
    lower = poly(c, q_lo) / (poly(d, q_lo) * q_lo + 1)
    q = p - 0.5
    r = q * q
    central = poly(a, r) * q / (poly(b, r) * r + 1)
    q_hi = F.sqrt(-2 * F.log(1 - p))
    upper = -poly(c, q_hi) / (poly(d, q_hi) * q_hi + 1)
    return (F.when(p < plow, lower)
            .when(p <= 1 - plow, central)
            .otherwise(upper))
