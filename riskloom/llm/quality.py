"""Quality from histogram gradient-boosted trees over document statistics.

Every whole text gives the numbers ``FEATURES`` names: shares of kinds of characters, word and line
lengths, repetition of words and lines. They are computed once in Arrow tasks and written; training and
scoring read them. Trees are trained in numpy on a bounded sample (at most about ``MAX_DOCS`` documents of
each class, chosen by a hash of doc_id and text, each pair once, weighted by the share that was drawn):
features are cut into at most ``BINS`` quantile bins, each level's gradient histograms of all nodes and
features are filled by one ``bincount`` and searched by their running sums. The trees are kept as complete
binary trees in three arrays, which a batch of documents descends together.

Defined results: a NULL text has the statistics of an empty one; labels that are neither 0 nor 1, and rows
without doc_id or text, teach nothing; a document labelled both 0 and 1 teaches both; if either class has
no row, every score is the share of class 1 among the labels (0 without labels); of equally good splits the
first feature's lowest bin is taken. A column of docs named ``features`` or ``score`` is replaced.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, hash_bound, read, small_batches, small_side, stage

MAX_DOCS = 8000
BINS, DEPTH, TREES, RATE, L2, LEAST_WEIGHT = 48, 4, 50, 0.2, 1.0, 5.0
THRESHOLD = 0.5

FEATURES = ("log_bytes", "log_words", "upper", "lower", "digit", "space", "stop", "symbol", "pipe", "control", "non_ascii", "word_bytes", "word_bytes_var",
            "distinct_words", "top_word", "top_ten_words", "same_as_before", "bare_words", "symbol_words", "shout_words", "words_a_stop", "log_lines", "distinct_lines", "line_words", "short_lines", "top_line")
#: Kinds of bytes, in the order of the features they give.
_KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\x0b\x0c\r", b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{}~", b"|")
_KIND = np.zeros((256, len(_KINDS) + 2))
for _k, _chars in enumerate(_KINDS):
    _KIND[list(_chars), _k] = 1
_KIND[[c for c in range(128) if not _KIND[c].any()], len(_KINDS)] = 1
_KIND[128:, len(_KINDS) + 1] = 1
_SYMBOL = re.compile(rb"[^\x00-\x20,.;:?'\"()A-Za-z0-9\x80-\xFF-]")
_LETTER = re.compile(rb"[A-Za-z0-9\x80-\xFF]")


def statistics(text: bytes) -> list[float]:
    """The document's FEATURES from its UTF-8 bytes; all 0 for an empty text."""
    if not text:
        return [0.0] * len(FEATURES)
    size = len(text)
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _KIND
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    common = counts.most_common(10)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    often = symbol = bare = shout = 0
    for w, c in counts.items():
        symbol += c * (_SYMBOL.search(w) is not None)
        bare += c * (_LETTER.search(w) is None)
        shout += c * (len(w) > 1 and w.isupper())
    lines = text.split(b"\n")
    different = Counter(lines)
    often = sum(map(operator.eq, words, words[1:]))
    short = sum(c for x, c in different.items() if len(x) < 30)
    return [float(np.log1p(size)), float(np.log1p(len(words))), *(kinds / size).tolist(), float(lengths.mean()), float(np.sqrt(lengths.var())), len(counts) / n,
            common[0][1] / n if common else 0.0, sum(c for _, c in common) / n, often / n, bare / n, symbol / n, shout / n, n / (1 + text.count(b".") + text.count(b"!") + text.count(b"?")),
            float(np.log1p(len(lines))), len(different) / len(lines), n / len(lines), short / len(lines), max(different.values()) / len(lines)]


def featurize(docs: DataFrame) -> DataFrame:
    """Every column of ``docs`` but text, and features (array<double>)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("features")
    kept = [c for c in docs.columns if c != "text"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [statistics(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(rows, pa.list_(pa.float64()))], [*kept, "features"])

    return docs.mapInArrow(run, docs.select(*kept, F.array().cast("array<double>").alias("features")).schema)


@dataclass
class Trees:
    """Complete binary trees: node k's children are 2k + 1 and 2k + 2; a row goes right if its feature is above the bound."""

    feature: np.ndarray  # trees x inner nodes
    bound: np.ndarray    # trees x inner nodes; infinite: all go left
    value: np.ndarray    # trees x leaves
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        at, tree, row = np.zeros((len(x), trees), int), np.arange(trees), np.arange(len(x))[:, None]
        while trees and inner and len(x) and at[0, 0] < inner:
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.bound[tree, at])
        return self.base + (self.value[tree, at - inner].sum(1) if trees else np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -500, 500)))


def cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Bounds between the bins of each feature: values of the sample, at most ``bins`` - 1."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))
        else:
            values = values[:-1]
        out.append(values)
    return out


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, l2: float = L2, least: float = LEAST_WEIGHT) -> Trees:
    """Boosted trees for 0/1 labels under the logistic loss."""
    share = float(np.average(y, weights=weight)) if len(y) else 0.0
    base = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 1)), base)
    n, width = x.shape
    bounds = cuts(x, bins)
    binned = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(bounds, x.T)], 1)  # bin k: values up to bounds[k]
    offset = np.arange(width) * bins
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, bound, value = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, int)
        for d in range(depth):
            nodes, first = 1 << d, (1 << d) - 1
            cell = ((node * width * bins)[:, None] + offset + binned).ravel()
            g, h = (np.bincount(cell, np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(2) for v in (grad, hess))
            g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
            gain = g * g / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - g_all ** 2 / (h_all + l2)
            gain[(h < least) | (h_all - h < least)] = 0
            flat = gain.reshape(nodes, -1)
            pick = flat.argmax(1)
            good = flat[np.arange(nodes), pick] > 1e-9
            f, b = pick // bins, pick % bins
            feature[t, first:first + nodes] = np.where(good, f, 0)
            bound[t, first:first + nodes] = [bounds[i][j] if ok and j < len(bounds[i]) else np.inf for i, j, ok in zip(f, b, good)]
            node = 2 * node + (good[node] & (binned[np.arange(n), f[node]] > b[node]))
        g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        value[t] = -rate * g / (h + l2)
        margin += value[t][node]
    return Trees(feature, bound, value, base)


def fit(features: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Trees:
    """Trees from ``features`` (doc_id, at: hash of doc_id and text or NULL, features) and ``labels`` (doc_id, quality).

    ValueError if the sample of a class that has rows has none.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").distinct()
    labelled = stage(features.filter("at is not null").select("doc_id", "at").distinct().join(known, "doc_id").select("quality", "doc_id", "at"), "labelled")
    sizes = {r["quality"]: r["count"] for r in labelled.groupBy("quality").count().collect()}
    bound = F.coalesce(*(F.when(F.col("quality") == k, F.lit(hash_bound(sizes.get(k, 0), max_docs))) for k in (0, 1)))
    sample = labelled.filter(F.col("at") <= bound)
    rows = (features.join(small_side(sample, 2 * max_docs, 32), ["doc_id", "at"]).select("quality", "doc_id", "at", "features").dropDuplicates(["quality", "doc_id", "at"]).toArrow()
            .sort_by([("quality", "ascending"), ("at", "ascending"), ("doc_id", "ascending")]))  # the same order whatever order the tasks end in
    y = rows.column("quality").to_numpy()
    drawn = {k: int((y == k).sum()) for k in (0, 1)}
    if missing := [k for k in sizes if not drawn[k]]:
        raise ValueError(f"no training row was drawn of class {missing}; raise max_docs")
    x = np.array(rows.column("features").to_pylist(), float).reshape(len(y), len(FEATURES))
    return train(x, y, np.array([sizes[k] / drawn[k] for k in y.tolist()], float) * (len(y) / max(1, sum(sizes.values()))))


def score(features: DataFrame, trees: Trees) -> DataFrame:
    """Every column of ``features`` and score."""
    features = features.drop("score")
    shared = features.sparkSession.sparkContext.broadcast(trees)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = part.column("features").flatten().to_numpy().reshape(part.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(x), pa.float64())], [*part.schema.names, "score"])

    return features.mapInArrow(run, features.select("*", F.lit(0.0).alias("score")).schema)


def learnable(labels: DataFrame) -> DataFrame:
    """The rows whose crc32(doc_id as text) mod 3 is not 1."""
    return labels.filter(crc_mod(F.col("doc_id"), 3) != 1)


def op12_quality(spark, sf_dir):
    """Quality of every whole text of documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("at", F.when(F.col("text").isNotNull(), F.xxhash64("doc_id", "text")))
    features = stage(featurize(docs), "features")
    trees = fit(features, learnable(read(spark, sf_dir, "labels").select("doc_id", "quality")))
    return score(features, trees).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
                                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
