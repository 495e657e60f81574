"""Toxicity from subword-bag embeddings.

A word's vector is the mean of the vectors of its subwords (the word itself and its character n-grams
of 3 to 5 characters, word ends marked), a document's the mean of its words' vectors (a word that
stands there n times weighs 1 + ln n), and a linear softmax on it gives the two classes. Vectors and
softmax are trained together (numpy, full-batch Adam, a penalty that keeps idle subwords at zero) on a
bounded sample: at most about ``MAX_DOCS`` documents of each class, chosen by a hash of doc_id and text (a
doc_id with the same text on several rows counts once). Since a misspelt word shares most n-grams with the word it was made from, it lands near it.

Scoring needs one number a subword bucket: its vector times the difference of the two class vectors.
Every whole text is scored in its task, words in a bounded cache.

Defined results: texts that are NULL or without words have the score of the bias alone; labels that
are neither 0 nor 1, and rows without doc_id or text, teach nothing; if either class has no row, every
score is the share of class 1 among the labels (0 without labels).
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from math import log
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, hash_bound, read, small_batches, small_side, stage

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
DIMS = 4
MAX_DOCS = 1500
STEPS = 80
RATE = 4.0
#: Step sizes of the vectors, the softmax and the bias, as parts of RATE.
RATES = (1.0, 0.005, 0.02)
#: Weight of the sum of the vectors' absolute components in the loss.
SPARSITY = 2e-6
#: Added to a text's weight of words, so that one word of a very short text does not decide it.
PRIOR_WORDS = 10
CACHE_WORDS = 200_000
HASHED_CHARS = 1 << 18
#: The words' values of the last model that this Python worker scored with: the next task need not hash them again.
_CACHES: dict[str, dict[str, float]] = {}
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")
#: The base of the words' hash polynomials: any odd number with many bits.
_FACTOR = 0x5851F42D4C957F2D
#: 1 + ln n of small counts.
_DAMPED = [0.0, *(1 + log(n) for n in range(1, 64))]


def _mixed(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of 64-bit numbers, all bits of them mixed."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, bucket) of every word and all its character n-grams; very long words are read in full.

    All words are hashed at once: a polynomial in their code points, word ends marked, for each n.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(code)) - starts[word]
    left = sizes[word] - at  # characters from here to the word's end
    power = np.cumprod(np.full(max(int(sizes.max()), max(GRAMS)), _FACTOR, np.uint64))
    rows, ids = [np.arange(len(words))], [_mixed(np.add.reduceat(code * power[at], starts), buckets)]
    for n in GRAMS:
        if len(code) < n:
            continue
        inside = np.flatnonzero(left[:len(code) - n + 1] >= n)
        h = np.full(len(inside), np.uint64(n) << np.uint64(57))
        for k in range(n):
            h += code[inside + k] * power[k]
        rows.append(word[inside])
        ids.append(_mixed(h, buckets))
    return np.concatenate(rows), np.concatenate(ids)


def word_weights(text: str | None) -> dict[str, float]:
    """The lower-cased words of the whole text, each with 1 + ln of its count."""
    return {w: _DAMPED[n] if n < len(_DAMPED) else 1 + log(n) for w, n in Counter(_WORD.findall((text or "").lower())).items()}


@dataclass
class Model:
    weights: np.ndarray  # a number a bucket
    bias: float

    def words(self, words: list[str]) -> list[float]:
        """Each word's value: the mean of its subwords' weights; HASHED_CHARS characters (or one word) are hashed at a time."""
        out: list[float] = []
        while len(out) < len(words):
            some = list(islice(words, len(out), len(out) + 1))
            size = len(some[0])
            for w in islice(words, len(out) + 1, None):
                size += len(w) + 2
                if size > HASHED_CHARS:
                    break
                some.append(w)
            row, bucket = subwords(some, len(self.weights))
            out += (np.bincount(row, self.weights[bucket], len(some)) / np.bincount(row, minlength=len(some))).tolist()
        return out


class Sparse:
    """A sparse matrix by rows, each row with at least one entry."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        order = np.argsort(row, kind="stable")
        self.col, self.value, self.shape = col[order], value[order].astype(np.float32), shape
        self.rows, self.starts = np.unique(row[order], return_index=True)

    def times(self, dense: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0], dense.shape[1]), np.float32)
        if len(self.rows):
            out[self.rows] = np.add.reduceat(dense[self.col] * self.value[:, None], self.starts)
        return out


def train(docs: list[dict[str, float]], labels: np.ndarray, steps: int = STEPS, rate: float = RATE, seed: int = 1) -> Model:
    """Fit on the word weights of documents and 0/1 labels; both classes weigh the same."""
    if not len(docs) or labels.min() == labels.max():
        share = labels.mean() if len(docs) else 0.0
        return Model(np.zeros(1, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    seen = Counter(w for d in docs for w in d)
    vocab = {w: k for k, w in enumerate(sorted(w for w, n in seen.items() if n > 1))}
    d_row, d_col, d_val = [], [], []
    for k, d in enumerate(docs):
        total = sum(d.values())
        for w, n in d.items():
            if w in vocab:
                d_row.append(k), d_col.append(vocab[w]), d_val.append(n / (total + PRIOR_WORDS))
    s_row, s_col = subwords(list(vocab))
    s_val = 1 / np.bincount(s_row, minlength=len(vocab))[s_row]
    used, s_col = np.unique(s_col, return_inverse=True)
    n_docs, n_words, n_used = len(docs), len(vocab), len(used)
    d_row, d_col, d_val = (np.array(x) for x in (d_row, d_col, d_val))
    doc_word, word_doc = Sparse(d_row, d_col, d_val, (n_docs, n_words)), Sparse(d_col, d_row, d_val, (n_words, n_docs))
    word_sub, sub_word = Sparse(s_row, s_col, s_val, (n_words, n_used)), Sparse(s_col, s_row, s_val, (n_used, n_words))
    rng = np.random.default_rng(seed)
    p = [np.zeros((n_used, DIMS), np.float32), rng.normal(0, 1, (DIMS, 2)).astype(np.float32), np.zeros(2, np.float32)]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    weight = (np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())[:, None]).astype(np.float32)
    target = np.eye(2, dtype=np.float32)[labels.astype(int)]
    for t in range(1, steps + 1):
        vector = doc_word.times(word_sub.times(p[0]))
        logit = vector @ p[1] + p[2]
        e = np.exp(logit - logit.max(1, keepdims=True))
        wrong = (e / e.sum(1, keepdims=True) - target) * weight
        grads = [sub_word.times(word_doc.times(wrong @ p[1].T)), vector.T @ wrong, wrong.sum(0)]
        for k, (x, g, m, v) in enumerate(zip(p, grads, first, second)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            scale = RATES[k] * rate / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
            x -= scale * m / (1 - 0.9 ** t)
            if k == 0:  # the penalty: what moves the loss less than SPARSITY stays zero
                x[:] = np.sign(x) * np.maximum(np.abs(x) - scale * SPARSITY, 0)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = p[0] @ (p[1][:, 1] - p[1][:, 0])
    return Model(weights, float(p[2][1] - p[2][0]))


def _count_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        counts = [word_weights(t.as_py()) for t in part.column("text")]
        yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([list(c) for c in counts], pa.list_(pa.string())),
                                          pa.array([list(c.values()) for c in counts], pa.list_(pa.float64()))], ["toxic", "words", "counts"])


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); ValueError if the sample of a class that has rows has none."""
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").distinct()
    texts = docs.select("doc_id", "text").filter("text is not null").withColumn("at", F.xxhash64("doc_id", "text"))
    labelled = stage(texts.select("doc_id", "at").join(known, "doc_id").select("toxic", "doc_id", "at").distinct(), "labelled")
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    bound = F.coalesce(*(F.when(F.col("toxic") == k, F.lit(hash_bound(sizes.get(k, 0), max_docs))) for k in (0, 1)))
    sample = labelled.filter(F.col("at") <= bound)
    rows = (texts.join(small_side(sample, 2 * max_docs, 32), ["doc_id", "at"]).dropDuplicates(["toxic", "doc_id", "at"])
            .select("toxic", "text").mapInArrow(_count_task, "toxic int, words array<string>, counts array<double>").toArrow())
    if missing := set(sizes) - set(rows.column("toxic").to_pylist()):
        raise ValueError(f"no training row was drawn of class {sorted(missing)}; raise max_docs")
    found = sorted(((t, dict(zip(w, n))) for t, w, n in zip(*(rows.column(c).to_pylist() for c in ("toxic", "words", "counts")))),
                   key=lambda x: (x[0], sorted(x[1].items())))  # the same order whatever order the tasks end in
    return train([d for _, d in found], np.array([t for t, _ in found]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every column of ``docs`` and ``score`` (replacing a column of that name)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score")
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if name not in _CACHES:
            _CACHES.clear()
            _CACHES[name] = {}
        cache = _CACHES[name]
        for part in parts:
            texts = [word_weights(t.as_py()) for t in part.column("text")]
            new = list({w for found in texts for w in found if w not in cache})
            values = dict(zip(new, model.words(new)))
            # the first words of a corpus are its frequent ones: once the cache is full it stays as it is
            cache.update(islice(values.items(), max(0, CACHE_WORDS - len(cache))))
            value = (cache if len(cache) < CACHE_WORDS else cache | values).__getitem__
            logits = [model.bias + sum(map(mul, map(value, found), found.values())) / (sum(found.values()) + PRIOR_WORDS) for found in texts]
            p = 1 / (1 + np.exp(-np.clip(np.array(logits, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], [*part.schema.names, "score"])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias("score")).schema)


def learnable(labels: DataFrame) -> DataFrame:
    """The rows whose crc32(doc_id as text) mod 3 is not 1."""
    return labels.filter(crc_mod(F.col("doc_id"), 3) != 1)


def op5_toxicity(spark, sf_dir):
    """Toxicity of every whole text of documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, learnable(read(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return score(docs, model).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
