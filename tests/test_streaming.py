"""The streaming deployment scores exactly what the batch path scores."""

import os
import tempfile

from pyspark.sql import functions as F

from riskloom.operators.learners import first_points
from riskloom.plans import datasets as DS
from riskloom.plans.pipeline import CreditScoringPipeline
from riskloom.streaming.scoring import score_stream


def test_stream_matches_batch(spark, sf_dir):
    sp = DS.splits(spark, sf_dir)
    train, val = sp.filter("split = 'train'"), sp.filter("split = 'val'")
    pipe = CreditScoringPipeline(first_points()).fit(train, val, modules=("S2",))
    src = os.path.join(tempfile.mkdtemp(prefix="riskloom-stream-"), "in")
    raw = val.drop("split", "clone_ord")
    raw.write.mode("overwrite").parquet(src)
    stream = score_stream(spark, src, raw.schema, pipe)
    q = stream.writeStream.format("memory").queryName("scored_stream").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("scored_stream")
    batch = pipe.predict_scores(raw)
    assert got.count() == batch.count()
    a = got.groupBy().agg(F.sum("S2"), F.min("S2"), F.max("S2")).first()
    b = batch.groupBy().agg(F.sum("S2"), F.min("S2"), F.max("S2")).first()
    assert abs(a[0] - b[0]) < 1e-6 and a[1] == b[1] and a[2] == b[2]
