"""Query registry: one Spark callable + (optionally) one DuckDB oracle per SURVEY §2 ID."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import round_doubles


@dataclass
class QuerySpec:
    key: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    digits: int = 6
    overrides: dict = field(default_factory=dict)
    doc: str = ""


REGISTRY: dict[str, QuerySpec] = {}


def register(key: str, sql: str | None = None, digits: int = 6, overrides: dict | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``key``.

    Floating columns are rounded (``digits``, per-column ``overrides``) so the value hash
    is engine-independent; the oracle SQL rounds the same columns the same way.
    """

    def deco(fn):
        spec = QuerySpec(key, fn, sql, digits, dict(overrides or {}), (fn.__doc__ or "").strip())

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), spec.digits, spec.overrides)

        spec.fn = run
        REGISTRY[key] = spec
        return fn

    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: v.fn for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v.sql for k, v in REGISTRY.items() if v.sql}


def _load():
    # Importing the catalog modules fills REGISTRY.
    from . import catalog  # noqa: F401
