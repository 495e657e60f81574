"""Streaming deployment of the batch serving path (C10 -> K8/K9 -> L10-L12).

Not a new operator: the same fitted preprocessor (frozen statistics), module scorers
and meta-model applied to a ``readStream`` source. Every step is a stateless row
projection, so no watermark or state store is needed; new files are scored as they
land and each micro-batch is written idempotently by the sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import PreprocessorModel
from ..operators.meta import risk_grade


def frozen(pre: PreprocessorModel) -> PreprocessorModel:
    """The same state with every statistic taken from train (pure projection)."""
    return PreprocessorModel(pre.state, fit_mode=True)


def score_stream(spark: SparkSession, source_dir: str, schema: T.StructType, pipeline, meta=None,
                 fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of (sample_id, S1..S4[, pd_score, predicted, risk_grade])."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(source_dir)
    x = frozen(pipeline.preprocessor).transform(raw)
    for m, mod in pipeline.modules.items():
        x = mod.append_score(x, m)
    keep = [c for c in ("sample_id", "default") if c in x.columns]
    scores = x.select(*keep, *pipeline.modules.keys())
    if meta is None:
        return scores
    return _with_meta(scores, meta)


def _with_meta(scores: DataFrame, meta) -> DataFrame:
    """PD, class and grade appended as columns (no join: the meta design keeps ids)."""
    out = meta.predict_proba(scores)
    return out.withColumn("predicted", (F.col("pd_score") >= F.lit(meta.state.threshold)).cast("int")) \
              .withColumn("risk_grade", risk_grade("pd_score"))


def start_scoring(stream: DataFrame, sink_dir: str, checkpoint_dir: str, trigger_once: bool = True):
    """Write scored micro-batches to parquet with a checkpointed (restartable) query."""
    w = stream.writeStream.format("parquet").option("path", sink_dir) \
        .option("checkpointLocation", checkpoint_dir).outputMode("append")
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
