"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import table_path

#: Largest side that an operator broadcasts by itself, in bytes; a larger one is shuffled.
BROADCAST_BYTES = 16 * 1024 * 1024


#: Rows that a task hands to Python at once: texts and sets are long, and a batch is held whole.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share."""
    small_batches(spark)
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and go on from there.

    Cuts the lineage (a lost executor rereads files, it recomputes nothing before them),
    and lets the optimizer see true sizes.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast where its checked size allows it; else leave the join to Spark."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def hash_bound(rows: int, most: float) -> int:
    """The largest xxhash64 of those that keep about ``most`` of ``rows`` distinct rows; all, if there are no more."""
    return max(-(1 << 63), min(1 << 64, int(most * (1 << 64) // max(1, rows))) - (1 << 63) - 1)


def blocks(rows: int, size: int) -> int:
    return max(1, ceil(rows / size))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(ident: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; NULL for a NULL id."""
    return F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(mod)).cast("int")
