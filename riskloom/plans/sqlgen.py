"""Small generators for DuckDB oracle text (kept next to the registry that uses them)."""

from __future__ import annotations

from collections.abc import Sequence

from .oracle_views import rnd

DUCK_STATS = {
    "count": "count({x})",
    "mean": "avg({x})",
    "std": "stddev_samp({x})",
    "std_pop": "stddev_pop({x})",
    "min": "min({x})",
    "max": "max({x})",
    "median": "quantile_cont({x}, 0.5)",
    "q25": "quantile_cont({x}, 0.25)",
    "q75": "quantile_cont({x}, 0.75)",
    "skew": "skewness({x})",
    "nulls": "sum(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END)",
}
INT_STATS = {"count", "nulls"}


def q(name: str) -> str:
    return '"' + name + '"'


def describe_sql(table: str, cols: Sequence[str], stats: Sequence[str],
                 group_cols: Sequence[str] = (), digits: int = 6) -> str:
    """UNION ALL of one grouped SELECT per feature (long form, like ``describe``)."""
    g = ", ".join(q(c) for c in group_cols)
    parts = []
    for c in cols:
        x = f"CAST({q(c)} AS DOUBLE)"
        sel = []
        for s in stats:
            e = DUCK_STATS[s].format(x=x)
            sel.append(f"CAST({e} AS BIGINT) AS {s}" if s in INT_STATS else f"{rnd(e, digits)} AS {s}")
        head = (g + ", ") if g else ""
        tail = f" GROUP BY {g}" if g else ""
        parts.append(f"SELECT {head}'{c}' AS feature, {', '.join(sel)} FROM {table}{tail}")
    return "\nUNION ALL\n".join(parts)


def pairs_sql(table: str, cols: Sequence[str], group_cols: Sequence[str] = ()) -> str:
    """Long-form pairwise correlations (i < j); NaN -> NULL."""
    g = ", ".join(q(c) for c in group_cols)
    parts = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            a, b = cols[i], cols[j]
            e = f"corr(CAST({q(a)} AS DOUBLE), CAST({q(b)} AS DOUBLE))"
            head = (g + ", ") if g else ""
            tail = f" GROUP BY {g}" if g else ""
            parts.append(f"SELECT {head}{i} AS i, {j} AS j, '{a}' AS feature_1, '{b}' AS feature_2, "
                         f"CASE WHEN isnan({e}) THEN NULL ELSE {e} END AS corr FROM {table}{tail}")
    return "\nUNION ALL\n".join(parts)


def pairs_long_ctes(table: str, cols: Sequence[str], id_col: str,
                    group_cols: Sequence[str] = (), prefix: str = "pl") -> list[str]:
    """CTEs ``{prefix}_pairs`` (group..., i, j, feature_1, feature_2, corr): unpivot once
    (NULLs dropped, so an inner self-join is pairwise-complete), pair up, aggregate."""
    g = list(group_cols)
    sel = ", ".join([q(id_col)] + [q(c) for c in g] + [f"CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in cols])
    on = ", ".join(q(c) for c in cols)
    ords = ", ".join(f"('{c}', {k})" for k, c in enumerate(cols))
    gsel = "".join(f"a.{q(c)}, " for c in g)
    gjoin = "".join(f" AND a.{q(c)} = b.{q(c)}" for c in g)
    gby = ", ".join([f"a.{q(c)}" for c in g] + ["oa.ord", "ob.ord", "a.feature", "b.feature"])
    return [
        f"{prefix}_long AS (UNPIVOT (SELECT {sel} FROM {table}) ON {on} INTO NAME feature VALUE value)",
        f"{prefix}_ord AS (SELECT * FROM (VALUES {ords}) AS t(feature, ord))",
        f"{prefix}_raw AS (SELECT {gsel}oa.ord AS i, ob.ord AS j, a.feature AS feature_1, b.feature AS feature_2, "
        f"corr(a.value, b.value) AS c FROM {prefix}_long a JOIN {prefix}_ord oa ON oa.feature = a.feature "
        f"JOIN {prefix}_long b ON b.{q(id_col)} = a.{q(id_col)}{gjoin} "
        f"JOIN {prefix}_ord ob ON ob.feature = b.feature AND ob.ord > oa.ord GROUP BY {gby})",
        f"{prefix}_pairs AS (SELECT * EXCLUDE (c), CASE WHEN isnan(c) THEN NULL ELSE c END AS corr FROM {prefix}_raw)",
    ]
