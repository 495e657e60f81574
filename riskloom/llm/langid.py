"""Language identification by partial matching.

A variable-order tree of byte contexts (up to ``ORDER`` preceding bytes) holds, for each language, the
symbol counts of the training texts. With the counts frozen, the probability of a byte after a context
is fixed: ``n / (N + q)`` where the byte was seen (N bytes, q distinct ones), else the escape probability
``q / (N + q)`` times that of the next shorter context with the seen bytes excluded, down to a uniform
order -1. The tree and all code lengths are laid out as arrays, so a text is scored in whole vectors:
walk the tree from each byte backwards to its longest known context, look up the code length there for
every language, add up. The shortest code names the language; its score is the share
``2^-bits / sum(2^-bits)``.

Training reads at most about ``MAX_DOCS`` whole documents of each language (chosen by a hash of
doc_id and text; all, if there are fewer; a doc_id with the same text on several rows counts once). Counting is a Spark aggregation; the driver holds one number for each
distinct byte string of ``ORDER + 1`` bytes of that sample.

Before that, texts are lower-cased and every run of ASCII characters other than letters is one space.

Defined results: a NULL text or one without a letter (Unicode L) is ``und`` with score 0, as is every
text if there is nothing to learn from; rows with NULL lang, text or doc_id teach nothing; equal code
lengths go to the first language in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, hash_bound, read, small_batches

ORDER = 4
MIN_COUNT = 24
MAX_DOCS = 1000
BLOCK = 1 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_CLEAN = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))


def normal_bytes(text: str) -> bytes:
    """Lower-cased UTF-8, runs of other ASCII characters as one space."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split())


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def _strings(data: bytes, order: int) -> np.ndarray:
    """The number of every string of ``order + 1`` bytes that ends at a byte of the text, or of the space after it."""
    x = np.frombuffer(b" " * order + data + b" ", np.uint8).astype(np.int64)
    out = np.zeros(len(x) - order, np.int64)
    for k in range(order + 1):
        out = out * 256 + x[k:len(x) - order + k]
    return out


def _count_task(order: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text")):
                by.setdefault(lang, []).append(_strings(normal_bytes(text.as_py()), order))
            for lang, found in by.items():
                s, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s), pa.string()), pa.array(s), pa.array(n.astype(np.int64))], ["lang", "string", "n"])

    return run


class ContextTrees:
    """Frozen statistics of all languages: child (node, symbol) -> node, bits (node, symbol, language).

    Node 0 is a sink, node 1 the root; deeper nodes have larger numbers. Symbols are the bytes seen in
    training and one for all others.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, min_count: int = MIN_COUNT):
        self.order, self.langs = order, sorted(counts)
        every = np.unique(np.concatenate([s for s, _ in counts.values()]))
        digits = np.stack([(every >> (8 * k)) & 255 for k in range(order + 1)])  # 0: the byte, k: the k-th before it
        seen = np.unique(digits)
        self.code = np.zeros(256, np.int64)
        self.code[seen] = np.arange(1, len(seen) + 1)
        size = self.size = len(seen) + 1
        symbols = self.code[digits]
        n = np.zeros((len(self.langs), len(every)))
        for k, lang in enumerate(self.langs):
            s, c = counts[lang]
            n[k, np.searchsorted(every, s)] = c

        def row_counts(node: np.ndarray, nodes: int, first: int) -> np.ndarray:
            at = (node - first) * size + symbols[0]
            ok = node > 0
            return np.stack([np.bincount(at[ok], x[ok], nodes * size) for x in n], axis=1).reshape(nodes, size, -1)

        def probabilities(c: np.ndarray, shorter: np.ndarray) -> np.ndarray:
            total, distinct = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            left = 1 - np.where(c > 0, shorter, 0).sum(1, keepdims=True)
            escape = np.where(left > 1e-9, distinct / np.maximum(total + distinct, 1) / np.maximum(left, 1e-9), 0)
            p = np.where(c > 0, c / np.maximum(total + distinct, 1), escape * shorter)
            return np.where(total > 0, np.maximum(p, 1e-12), shorter)

        node = np.ones(len(every), np.int64)
        child = [np.zeros((2, size), np.int64)]
        p = probabilities(row_counts(node, 1, 1), np.full((1, size, len(self.langs)), 1 / size))
        levels, first = [p], 1
        for k in range(1, order + 1):
            key = np.where(node > 0, node * size + symbols[k], -1)
            keys, back = np.unique(key, return_inverse=True)
            weight = np.stack([np.bincount(back, x, len(keys)) for x in n]).max(0)  # a context counts if any language has it often enough
            good = (keys >= 0) & (weight >= min_count)
            number = np.zeros(len(keys), np.int64)
            start = first + len(levels[-1])
            number[good] = start + np.arange(good.sum())
            child[-1][keys[good] // size - (first if k > 1 else 0), keys[good] % size] = number[good]
            node = number[back]
            if not good.any():
                break
            p = probabilities(row_counts(node, int(good.sum()), start), levels[-1][keys[good] // size - first])
            levels.append(p)
            child.append(np.zeros((int(good.sum()), size), np.int64))
            first = start
        self.child = np.concatenate(child).astype(np.int32).ravel()
        self.bits = -np.log2(np.concatenate([np.ones((1, size, len(self.langs))), *levels])).astype(np.float32).reshape(-1, len(self.langs))

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits of a text (and the space after it) under each language; BLOCK bytes at a time."""
        x = self.code[np.frombuffer(b" " * self.order + data + b" ", np.uint8)].astype(np.int32)
        total = np.zeros(len(self.langs))
        for at in range(self.order, len(x), BLOCK):
            end = min(len(x), at + BLOCK)
            now = best = np.ones(end - at, np.int32)
            for k in range(1, self.order + 1):
                now = self.child[now * self.size + x[at - k:end - k]]
                best = np.maximum(best, now)
            total += self.bits[best * self.size + x[at:end]].sum(0, dtype=np.float64)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not has_letter(text):
            return UNKNOWN, 0.0
        bits = self.code_lengths(normal_bytes(text))
        k = int(bits.argmin())
        return self.langs[k], float(1 / np.exp2(bits[k] - bits).sum())


def fit(train: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, max_docs: int = MAX_DOCS) -> ContextTrees | None:
    """Trees from ``train`` (doc_id, text, lang); None if it has no usable row, ValueError if a language's sample has none."""
    small_batches(train.sparkSession)
    rows = train.select("doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null").withColumn("at", F.xxhash64("doc_id", "text"))
    sizes = rows.select("lang", "doc_id", "at").distinct().groupBy("lang").count().collect()  # a row a language
    if not sizes:
        return None
    bound = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.lit(hash_bound(r["count"], max_docs))) for r in sizes))
    sample = rows.filter(F.col("at") <= bound).dropDuplicates(["lang", "doc_id", "at"])
    found = sample.select("lang", "text").mapInArrow(_count_task(order), "lang string, string long, n long").groupBy("lang", "string").agg(F.sum("n").alias("n")).toArrow()
    lang = np.array(found.column("lang").to_pylist())
    if missing := {r["lang"] for r in sizes} - set(lang.tolist()):
        raise ValueError(f"no training row was drawn of {sorted(missing)}; raise max_docs")
    string, n = found.column("string").to_numpy(), found.column("n").to_numpy()
    return ContextTrees({x: (string[lang == x], n[lang == x]) for x in sorted(set(lang.tolist()))}, order, min_count)


def identify(docs: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """Every column of ``docs`` with lang_pred and score (replacing columns of those names)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    if trees is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [shared.value.predict(t.as_py()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                                             [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows whose crc32(doc_id as text) mod 4 is not 2."""
    return docs.filter(crc_mod(F.col("doc_id"), 4) != 2)


def op10_langid(spark, sf_dir):
    """Language of every whole text of documents."""
    docs = read(spark, sf_dir, "documents")
    trees = fit(learnable(docs.select("doc_id", "text", "lang")))
    out = identify(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
