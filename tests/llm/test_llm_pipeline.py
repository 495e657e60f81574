"""The pipeline against brute force, stage by stage, and on odd rows."""

import duckdb
import pandas as pd
import pytest
from llm_cases import EDGES, classes, dedup, doc_words, documents, hits

import corpus_pipeline
from riskloom.llm import mixing
from riskloom.llm.common import read, stage


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]


def test_stages_match_brute_force(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights"]
    items = [(r["item_id"], r["text"]) for r in read(spark, sf_dir, "benchmark").collect()]
    docs = read(spark, sf_dir, "documents")
    before, columns = rows_of(docs), docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "tested")
        assert docs.columns == columns
        after = rows_of(docs)
        if name == "language ID":
            assert set(after) <= set(before)
            assert {x for x in before if any(c.isalpha() for c in x[1] or "")} == set(after)  # clean documents stay
        elif name == "line dedup":
            assert after == [(i, t) for i, _, _, t in dedup(before)]
        elif name == "MinHash near-dedup":
            assert after == [x for x, (i, _, c) in zip(before, classes(before, 5)) if i == c]
        else:
            assert after == [(i, t) for i, t in before if not (h := len(hits(t, items)[0])) or 20 * h < len(doc_words(t))]
        before = after
    left = docs.select("doc_id", "text", "source").toPandas()
    con = duckdb.connect()
    con.register("left_over", pd.DataFrame(left))
    want = sorted(con.execute(mixing.taken_sql("left_over")).fetchall())
    got = sorted(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect())
    assert got == want


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    taken, size = out.selectExpr("sum(taken)", "sum(size)").first()
    assert abs(taken - 1.5 * size) < 100


@pytest.mark.parametrize("rows", [EDGES, []])
def test_odd_rows_pass_through(spark, sf_dir, rows):
    docs = documents(spark, rows)
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf_dir), "odd")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    # nothing to learn a language from: all texts are undecided and go
    assert docs.count() == 0


def test_odd_rows_after_language_id(spark, sf_dir):
    docs = documents(spark, EDGES).select(corpus_pipeline.COLUMNS)
    for _, step in corpus_pipeline.STAGES[1:-1]:
        docs = stage(step(spark, docs, sf_dir), "odd")
    ids = [r["doc_id"] for r in docs.collect()]
    assert ids.count(6) == 1 and 7 not in ids and ids.count(10) == 1 and 11 not in ids
    assert {1, 2, 3, 8, 9, 14, -5, 2**53 + 1} <= set(ids)
