"""Sampling, shuffles, splits, folds and the QA report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import rank as RK
from ..operators import sampling as S
from ..sources import fixtures as FX
from ..sources.contract import ID_COL
from . import datasets as DS
from .oracle_views import oversample_ctes, rnd, split_ctes, with_views
from .registry import register

D67 = ("dataset67",)
OS = oversample_ctes()
SP = OS + split_ctes()


@register("G4_seeded_shuffle", with_views(
    "SELECT sample_id, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(sample_id AS VARCHAR), '42'))) - 1 "
    "AS shuffle_pos FROM dataset67", *D67))
def q_g4(spark, sf_dir):
    """Seeded permutation position of every row (md5(id|seed) order)."""
    return RK.seeded_shuffle(DS.dataset67(spark, sf_dir).select(ID_COL), [ID_COL])


@register("G5_oversample", with_views(
    "SELECT sample_id, clone_ord, \"default\", industry_code, " + rnd("roa") + " AS roa FROM oversampled",
    *D67, extra=OS))
def q_g5(spark, sf_dir):
    """Minority oversampling to an 8.5 % default rate (clones drawn with replacement)."""
    return DS.oversampled(spark, sf_dir).select(ID_COL, "clone_ord", "default", "industry_code", "roa")


@register("G5b_oversample_balance", with_views(
    'SELECT count(*) AS total, CAST(sum("default") AS BIGINT) AS defaults, '
    'CAST(sum(1 - "default") AS BIGINT) AS non_defaults, ' + rnd('avg(CAST("default" AS DOUBLE))')
    + " AS default_rate FROM oversampled", *D67, extra=OS))
def q_g5b(spark, sf_dir):
    """Class balance after oversampling."""
    return S.class_balance(DS.oversampled(spark, sf_dir))


@register("G6_stratified_split", with_views(
    "SELECT sample_id, clone_ord, industry_code, \"default\", split FROM splits", *D67, extra=SP))
def q_g6(spark, sf_dir):
    """Stratified 70/15/15 split by (industry, default) after oversampling."""
    return DS.splits(spark, sf_dir).select(ID_COL, "clone_ord", "industry_code", "default", "split")


@register("F27_split_summary", with_views(
    "SELECT split, count(*) AS rows, " + rnd('avg(CAST("default" AS DOUBLE))') + " AS default_rate, "
    + rnd("count(*) / sum(count(*)) OVER ()") + " AS share FROM splits GROUP BY split", *D67, extra=SP))
def q_f27(spark, sf_dir):
    """size, share and default rate per split."""
    return S.split_summary(DS.splits(spark, sf_dir))


@register("F27b_split_industry_mix", with_views(
    "SELECT split, industry_code, count(*) AS rows, "
    + rnd("count(*) / sum(count(*)) OVER (PARTITION BY split)") + " AS share FROM splits GROUP BY split, industry_code",
    *D67, extra=SP))
def q_f27b(spark, sf_dir):
    """industry mix within each split."""
    return S.split_industry_mix(DS.splits(spark, sf_dir))


def _dup_sql():
    from .catalog_profile import D67_COLUMNS
    from .sqlgen import q
    cols = ", ".join(q(c) for c in D67_COLUMNS)
    miss = " + ".join(f"sum(CASE WHEN {q(c)} IS NULL THEN 1 ELSE 0 END)" for c in D67_COLUMNS)
    return (f"SELECT (SELECT CAST(sum(k - 1) AS BIGINT) FROM (SELECT count(*) AS k FROM oversampled GROUP BY {cols}) g) "
            f"AS duplicates, CAST({miss} AS BIGINT) AS missing_cells, count(*) AS rows FROM oversampled")


@register("F12_duplicates", with_views(_dup_sql(), *D67, extra=OS))
def q_f12(spark, sf_dir):
    """duplicate rows (clones are exact copies) and total missing cells."""
    return P.duplicate_rows(DS.oversampled(spark, sf_dir).drop("clone_ord"))


@register("G7_stratified_folds", with_views(
    "SELECT sample_id, \"default\", CAST((row_number() OVER (PARTITION BY \"default\" ORDER BY "
    "md5(concat_ws('|', CAST(sample_id AS VARCHAR), 'fold', '42'))) - 1) % 5 AS INT) AS fold FROM dataset67",
    *D67))
def q_g7(spark, sf_dir):
    """Seeded stratified 5-fold assignment (classifier CV)."""
    return S.stratified_folds(DS.dataset67(spark, sf_dir).select(ID_COL, "default"))


@register("G7b_contiguous_folds", with_views(
    "SELECT sample_id, CAST(CASE WHEN p < (n // 5 + 1) * (n % 5) THEN p // (n // 5 + 1) "
    "ELSE n % 5 + (p - (n // 5 + 1) * (n % 5)) // greatest(n // 5, 1) END AS INT) AS fold FROM ("
    "SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS p, count(*) OVER () AS n FROM dataset67) t",
    *D67))
def q_g7b(spark, sf_dir):
    """Unshuffled contiguous 5-fold assignment (regression CV)."""
    return S.contiguous_folds(DS.dataset67(spark, sf_dir).select(ID_COL), ID_COL)


@register("I3_renumber_after_union", with_views(
    "SELECT sample_id AS source_id, clone_ord, row_number() OVER (ORDER BY sample_id, clone_ord) AS new_id "
    "FROM oversampled", *D67, extra=OS))
def q_i3(spark, sf_dir):
    """Ids 1..n after the clone union, in (sample_id, clone) order."""
    df = DS.oversampled(spark, sf_dir).select(F.col(ID_COL).alias("source_id"), "clone_ord")
    return RK.renumber(df, "source_id", ["clone_ord"], out="new_id")


def _qa_sql():
    from .catalog_profile import D67_COLUMNS
    from .sqlgen import q
    miss = " + ".join(f"sum(CASE WHEN {q(c)} IS NULL THEN 1 ELSE 0 END)" for c in D67_COLUMNS)
    cols = ", ".join(q(c) for c in D67_COLUMNS)
    return (
        "SELECT 'dataset' AS section, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM oversampled UNION ALL "
        f"SELECT 'dataset', 'columns', CAST({len(D67_COLUMNS)} AS DOUBLE) UNION ALL "
        "SELECT 'dataset', 'default_rate_pct', " + rnd('avg(CAST("default" AS DOUBLE)) * 100', 4) + " FROM oversampled UNION ALL "
        "SELECT 'splits', split || '_rows', CAST(count(*) AS DOUBLE) FROM splits GROUP BY split UNION ALL "
        "SELECT 'splits', split || '_pct', " + rnd("count(*) * 100.0 / (SELECT count(*) FROM splits)", 4)
        + " FROM splits GROUP BY split UNION ALL "
        f"SELECT 'quality', 'missing_values', CAST({miss} AS DOUBLE) FROM oversampled UNION ALL "
        f"SELECT 'quality', 'duplicates', CAST((SELECT sum(k - 1) FROM (SELECT count(*) AS k FROM oversampled "
        f"GROUP BY {cols}) g) AS DOUBLE) UNION ALL "
        "SELECT 'industry', CAST(industry_code AS VARCHAR) || '_rows', CAST(count(*) AS DOUBLE) FROM oversampled "
        "GROUP BY industry_code")


@register("A11_qa_report", with_views(_qa_sql(), *D67, extra=SP), digits=4)
def q_a11(spark, sf_dir):
    """Data-quality report as a tidy (section, metric, value) frame."""
    from ..operators.report import qa_report
    return qa_report(DS.splits(spark, sf_dir))
