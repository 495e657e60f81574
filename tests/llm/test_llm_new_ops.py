"""Merkle manifest, quality trees and lexical search against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from llm_cases import EDGES, EXTRA, LONG, documents, lower
from pyspark.sql import functions as F

from riskloom.llm import lexical, merkle, quality
from riskloom.llm.common import read

# --- Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests, fan=16):
    """(root, siblings of each leaf level by level as (left, right))."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for k, i in enumerate(at):
            run = i // fan * fan
            paths[k].append((digests[run:i], digests[i + 1:run + fan]))
        digests, at = [H(*digests[i:i + fan]) for i in range(0, len(digests), fan)], [i // fan for i in at]
    return digests[0], paths


def brute_merkle(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    leaves = []
    for i, s, lang, n, t in rows:
        def leaf(x, i=i, s=s, lang=lang, n=n):
            return H(field(i), field(s), field(lang), field(n), field(x))
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and t is not None
        leaves.append((s, i, leaf(t), leaf(lower(t)) if tampered else leaf(t)))
    leaves.sort(key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1] is not None, x[1] or 0, x[2]))
    sources = sorted({x[0] for x in leaves}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in leaves if x[0] == s]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for (_, i, leaf, claim), path in zip([x for x in leaves if x[0] == s], trees[s][1]):
            h = claim
            for left, right in path + top:
                h = H(*left, h, *right)
            out.append((i, leaf, trees[s][0], root, H(*(d for left, right in path + top for d in left + right)), h, h == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def merkle_rows(spark, rows):
    full = [(*r[:2], *r[2:], *["x", 7, "y", 8, *["z"] * 8]) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, source string, lang string, n_chars long, text string, {EXTRA}")


@pytest.mark.parametrize("room", [None, 100_000, 0])
def test_merkle_edges(spark, monkeypatch, room):
    if room is not None:  # upper levels broadcast, or none
        monkeypatch.setattr(merkle, "BROADCAST_BYTES", room)
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "b", "ä", "", "Z z"]), rng.choice([None, "en"]), rng.choice([None, 3]), t) for i, t in EDGES]
    rows += [(k, "hot", "en", k, f"Text {k % 7}") for k in range(300)] + [(5, "hot", "en", 5, "Text 5")] * 40 + [(77, "lone", None, None, "Alone")]
    rows += [(k, f"s{k}", None, None, None) for k in range(20)]
    df = merkle_rows(spark, rows).repartition(5)
    out = merkle.climb(merkle.build(merkle.document_leaves(df)))
    assert out.columns == COLUMNS
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_merkle(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_merkle_small_trees(spark, n):
    rows = [(k, "one", "en", k, "ABC") for k in range(n)]
    out = merkle.climb(merkle.build(merkle.document_leaves(merkle_rows(spark, rows)))).collect()
    assert sorted((tuple(r) for r in out), key=str) == (brute_merkle(rows) if n else [])


# --- quality


def walk(trees, t, x):
    k, inner = 0, trees.feature.shape[1]
    while k < inner:
        k = 2 * k + 1 + int(x[trees.feature[t, k]] > trees.bound[t, k])
    return trees.value[t, k - inner]


def test_flat_trees_are_walked_like_nodes():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 5)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(int)
    trees = quality.train(x, y, np.ones(400), trees=12, depth=3)
    assert np.allclose(trees.margins(x), [trees.base + sum(walk(trees, t, r) for t in range(12)) for r in x])
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.95
    assert trees.margins(x[:0]).shape == (0,)


def test_first_split_is_the_best_of_all_splits():
    rng = np.random.default_rng(2)
    x, w = np.round(rng.normal(size=(60, 3)), 1), rng.uniform(0.5, 2, 60)
    y = (x[:, 1] + rng.normal(0, 0.5, 60) > 0).astype(int)
    trees = quality.train(x, y, w, trees=1, depth=1, bins=64, least=0.0)
    p = np.average(y, weights=w)
    g, h = w * (p - y), w * p * (1 - p)

    def gain(f, b):
        left = x[:, f] <= b
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)

    best = max(gain(f, b) for f in range(3) for b in np.unique(x[:, f])[:-1])
    assert gain(trees.feature[0, 0], trees.bound[0, 0]) == pytest.approx(best)
    left = x[:, trees.feature[0, 0]] <= trees.bound[0, 0]
    assert trees.value[0] == pytest.approx([-quality.RATE * g[s].sum() / (h[s].sum() + 1) for s in (left, ~left)])


def test_statistics_of_odd_texts():
    for _, t in EDGES:
        got = quality.statistics((t or "").encode())
        assert len(got) == len(quality.FEATURES) and np.isfinite(got).all()
    named = dict(zip(quality.FEATURES, quality.statistics("AB ab ab | 12.\nab".encode())))
    assert named["log_words"] == pytest.approx(log(7)) and named["same_as_before"] == pytest.approx(1 / 6) and named["bare_words"] == pytest.approx(1 / 6)
    assert named["shout_words"] == pytest.approx(1 / 6) and named["distinct_words"] == pytest.approx(4 / 6)


def test_quality_edges(spark):
    df = documents(spark, EDGES + [(100 + k, f"good words number {k} here.") for k in range(40)] + [(200 + k, f"B@D!! {k}" * 3) for k in range(40)])
    rows = df.withColumn("at", F.when(F.col("text").isNotNull(), F.xxhash64("doc_id", "text"))).withColumn("features", F.lit("clash"))
    features = quality.featurize(rows).cache()
    labels = spark.createDataFrame([(100 + k, 1, 0) for k in range(40)] + [(200 + k, 0, 0) for k in range(40)] + [(None, 1, 1), (3, None, 1), (4, 7, 1), (101, 1, 1)], "doc_id long, quality int, score int")
    trees = quality.fit(features, labels)
    out = quality.score(features, trees).collect()
    assert len(out) == len(EDGES) + 80 and all(0 <= r["score"] <= 1 for r in out)
    assert all((r["score"] >= 0.5) == (r["doc_id"] < 200) for r in out if r["doc_id"] is not None and 100 <= r["doc_id"] < 240)
    by_id = {r["doc_id"]: r["score"] for r in out if r["doc_id"] in (1, 2)}
    assert by_id[1] == by_id[2]  # NULL is empty
    one = quality.fit(features, labels.filter("quality = 1 or doc_id is null"))
    assert all(r["score"] > 1 - 1e-6 for r in quality.score(features, one).collect())
    assert all(r["score"] < 1e-6 for r in quality.score(features, quality.fit(features, labels.filter("false"))).collect())
    assert quality.score(features.filter("false"), trees).count() == 0
    with pytest.raises(ValueError):
        quality.fit(features, labels, max_docs=0)


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op12_quality(spark, sf).join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in out]
    assert len(out) > 80 and sum(right) / len(right) > 0.97
    pos, neg = ([r["score"] for r in out if r["quality"] == q] for q in (1, 0))
    assert sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) > 0.98


# --- lexical search


def doc_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))


def brute_search(docs, items, k):
    counts = [(i, Counter(doc_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    queries = {}
    for i, t in items:
        if t is not None:
            queries.setdefault(i, Counter()).update(doc_terms(t))
    out = []
    for item, q in queries.items():
        scored = []
        for (i, c), n in zip(counts, sizes):
            if n:
                m = 25 + (75 * n * n_docs) // n_terms
                s = sum(x * floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in q.items() if c[t])
                if s > 0:
                    scored.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("docs_a_block, item_bytes, k", [(8192, 1 << 22, 10), (3, 9000, 2)])
def test_search_edges(spark, monkeypatch, docs_a_block, item_bytes, k):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", docs_a_block)
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)
    rng = random.Random(3)
    words = [f"t{j}" for j in range(60)]
    docs = EDGES + [(1000 + j, " ".join(rng.choices(words, [1 / (r + 1) for r in range(60)], k=rng.randint(1, 40)))) for j in range(150)]
    docs += [(2000, "tie tie other"), (1999, "tie tie other"), (1999, "tie tie other"), (None, "tie tie other")]
    items = [(j, " ".join(rng.choices(words, k=8))) for j in range(6)] + [(50, "tie"), (51, "THE the Fox 日本語 ÜNÏ"), (52, ""), (53, None), (54, "!!"), (None, "fox dog"), (55, "t1 t2"), (55, "t3 t59"),
                                                                           (56, "nowhere"), (57, LONG[:20_000])]
    df = documents(spark, docs).repartition(4)
    benchmark = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in items], "item_id long, text string, rank string, score int, doc_id int")
    out = lexical.search(df, benchmark, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_search(docs, items, k)
    if docs_a_block == 3:
        assert lexical.search(df.filter("false"), benchmark).count() == 0
        assert lexical.search(df, benchmark.filter("false")).count() == 0


def test_accumulators_are_limited():
    """Documents that only common terms meet get no accumulator once k better ones are sure."""
    n = 2000
    doc = np.concatenate([np.arange(n), np.arange(20)])
    term = np.concatenate([np.zeros(n, int), np.ones(20, int)])
    block = lexical.Block(np.full(n, 50), doc, term, np.ones(n + 20, int), n, 50 * n)
    docs, scores = block.search([(1, lexical.weight(n, 20)), (0, lexical.weight(n, n - 5))], 10)
    assert len(docs) == 20 and sorted(docs.tolist()) == list(range(20)) and len(set(scores.tolist())) == 1
    assert len(block.search([(1, 5), (0, 6)], 10)[0]) == n  # the common term may still lift others
