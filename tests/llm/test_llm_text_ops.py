"""Line dedup, decontamination and near-duplicates against brute force, edge cases included."""

import random

import pytest
from llm_cases import EDGES, LONG, SHARED, classes, dedup, doc_words, documents, hits

from riskloom.llm import decontam, linededup, minhash


def key(row):
    return tuple((x is not None, x) for x in row)


def test_line_dedup_edges(spark, monkeypatch):
    line = "This line is long enough to be counted as a repeated one"
    rows = EDGES + [(20 + k, f"own text {k}\n  {line.upper() if k % 2 else line}\t\nend {k}\n{line}") for k in range(6)]
    rows += [(None, line), (40, f"{line[:39]}\n" * 3), *[(50 + k, "é" * 39 + "\n" + "é" * 40) for k in range(5)]]
    want = sorted(dedup(rows), key=key)
    got = linededup.dedup_lines(documents(spark, rows))
    assert [c for c in got.columns if c not in ("n_lines", "n_dropped")] == [c for c in documents(spark, []).columns if c not in ("n_lines", "n_dropped")]
    have = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()), key=key)
    assert have == want
    assert sum(r[2] for r in want) > 5


def test_line_dedup_with_a_full_filter_and_listed_lines(spark, monkeypatch):
    """A filter far too small lets all lines through to the exact count; too many repeats go by join."""
    rows = [(k, "\n".join(f"line number {(k * j) % 37} which is shared by quite a few documents" for j in range(5))) for k in range(60)]
    monkeypatch.setattr(linededup, "MIN_FILTER_BITS", 8 * linededup.SEGMENT_BYTES)
    monkeypatch.setattr(linededup, "MAX_FILTER_BITS", 8 * linededup.SEGMENT_BYTES)
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", 0)
    have = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in linededup.dedup_lines(documents(spark, rows)).collect())
    assert have == sorted(dedup(rows))


ITEMS = [(1, SHARED), (2, "quick brown fox"), (None, "one"), (3, None), (4, "..."), (5, "again"), (6, "w0 v0 w1 v1 w2 v2 w3 v3 w4 v4 w5 v5 w6 v6 w7"), (6, "large"),
         (7, "only half of this quick brown fox jumps over")]


@pytest.mark.parametrize("fits", [True, False])
def test_decontamination_edges(spark, monkeypatch, fits):
    if not fits:
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, tag string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"]), r["contaminated"]) for r in decontam.contamination(documents(spark, EDGES), items).collect()), key=key)
    want = []
    for i, t in EDGES:
        pos, ids = hits(t, ITEMS)
        n = len(doc_words(t))
        want.append((i, n, len(pos), len(ids), tuple(sorted(ids)), bool(pos) and 20 * len(pos) >= n))
    assert got == sorted(want, key=key)
    left = decontam.clean_documents(documents(spark, EDGES), items)
    assert left.count() == sum(not r[-1] for r in want)
    assert left.columns == documents(spark, []).columns


def test_winnowing_misses_no_shared_span(spark):
    rng = random.Random(5)
    word = [f"t{k}" for k in range(30)]
    items = [(k, " ".join(rng.choices(word, k=rng.choice([3, 8, 13, 14, 40])))) for k in range(30)]
    docs = []
    for k in range(60):
        own = rng.choices(word, k=rng.randint(0, 60))
        part = items[rng.randrange(30)][1].split()
        cut = part[rng.randint(0, 3):len(part) - rng.randint(0, 3)]
        docs.append((k, " ".join(own[:10] + cut + own[10:])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], tuple(r["items"])) for r in decontam.contamination(documents(spark, docs), bench).collect()}
    for i, t in docs:
        pos, ids = hits(t, items)
        assert got[i] == (len(pos), tuple(sorted(ids)))


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_edges(spark, n):
    rng = random.Random(n)
    base = [f"b{k}" for k in range(400)]
    rows = list(EDGES)
    for k in range(25):  # chains: each copy changes some words of an earlier one
        for _ in range(rng.randint(0, 12)):
            base[rng.randrange(400)] = f"c{rng.random()}"
        rows.append((100 + k, " ".join(base)))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(documents(spark, rows), n=n).collect()), key=key)
    assert got == sorted(classes(rows, n), key=key)


def test_near_duplicates_cross_links_in_blocks(spark, monkeypatch):
    """Sets that are like some of a bucket but not like its hub are found, whatever the block size."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "HUB_CHUNK", 2)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(300)]
    rows = []
    for k in range(60):
        words = list(base)
        for j in rng.sample(range(300), rng.randint(5, 40)):
            words[j] = f"x{k}_{j}" if rng.random() < 0.3 else f"y{j}"
        rows.append((k, " ".join(words)))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(documents(spark, rows), n=2).collect())
    want = sorted(classes(rows, 2))
    assert got == want
    assert 1 < len({r[2] for r in want}) < 60


def test_one_of_each_keeps_columns_and_one_row(spark):
    docs = documents(spark, EDGES)
    left = minhash.one_of_each(docs, n=5)
    ids = sorted((r["doc_id"] for r in left.collect()), key=lambda x: (x is not None, x))
    assert left.columns == docs.columns
    assert ids.count(7) == 0 and ids.count(6) == 1 and ids.count(11) == 0 and ids.count(5) == 0
    assert {1, 2, 3, 4, 8, 9, 12} <= set(ids)


def test_estimate_is_unbiased():
    import numpy as np

    rng = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.8, 0.95):
        e = []
        for _ in range(60):
            x = rng.integers(0, 2**63, 600).astype(np.uint64)
            k = int(round(600 * 2 * share / (1 + share)))
            y = np.concatenate([x[:k], rng.integers(0, 2**63, 600 - k).astype(np.uint64)])
            a, b = (np.frombuffer(minhash.signature(minhash.minima(s)), np.uint8) for s in (x, y))
            e.append(minhash.estimates(a, b[None, :])[0])
        assert abs(np.mean(e) - share) < 0.03


def test_long_text_is_read_whole(spark):
    docs = documents(spark, [(1, LONG + " " + SHARED)])
    bench = spark.createDataFrame([(1, SHARED)], "item_id long, text string")
    assert decontam.contamination(docs, bench).first()["n_hit"] == 18


def test_empty_tables(spark):
    none = documents(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert linededup.dedup_lines(none).count() == 0
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(documents(spark, EDGES), bench).filter("n_hit > 0").count() == 0
    assert minhash.near_duplicates(none).count() == 0
