"""Base-table access: parquet scans that let Catalyst prune columns and push filters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Parquet scan; selecting ``cols`` right away keeps ReadSchema narrow."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*cols) if cols else df
