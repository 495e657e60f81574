"""Personal data: patterns for protected entities, and the terms that give them away.

Base: e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers. Each value found is a
protected entity.

Information-theoretic sanitisation: a term that stands near one entity again and again discloses it.
For each term within ``WINDOW`` words of an entity the corpus gives ``P(entity | term)`` (documents with
the term near the entity, of all documents with the term) and the information
``log2(P(entity | term) / P(entity))`` in bits. Pairs seen in fewer than ``MIN_CONTEXTS`` different
contexts (so that copies of one text count once) are no evidence. A term that discloses an entity with
at least ``GENERALISE`` and ``MIN_BITS`` is generalised to ``[TERM]`` wherever it stands, with at least
``REMOVE`` it is removed.

Every figure is a Spark aggregation over all documents; work is linear in the text, also for texts of one
endless word or number (the patterns never look at a run twice).

Defined results: a NULL text is empty for the spans and stays NULL; rows that share a doc_id are
documents of their own; terms have at least ``MIN_TERM`` characters and never overlap a base span; of a
match that fails its check no part is tried again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower, read, small_side, stage

KINDS = ("email", "ip", "card", "phone")
WINDOW, MIN_CONTEXTS, MIN_TERM = 16, 3, 3
GENERALISE, REMOVE, MIN_BITS = 0.5, 0.9, 5.0

#: A run of possible characters is passed whole, with what makes it an address if that follows.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in _EMAIL.finditer(text) if m[1]]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if m[1] and all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 15:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def entity(kind: str, value: str) -> bytes:
    """Identity of a protected value: 128 bits of its normal form."""
    value = value.lower() if kind in ("email", "ip") else "".join(c for c in value if c.isdigit())
    return xxhash.xxh3_128_digest(f"{kind}:{value}".encode())


def normal_term(word: str) -> str:
    """A-Z to a-z and nothing else."""
    return word.lower() if word.isascii() else word.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, term) of the words outside the base spans."""
    taken, k = sorted((s, e) for _, s, e in spans), 0
    for m in _TERM.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] < m.end():
            continue
        if m.end() - m.start() >= MIN_TERM:
            yield m.start(), m.end(), normal_term(m[0])


def contexts(text: str, window: int) -> Iterator[tuple[bytes, int, list[str]]]:
    """(entity, hash of the context, distinct terms) for each base span."""
    spans = base_spans(text)
    if not spans:
        return
    terms, at = list(free_terms(text, spans)), 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        while at < len(terms) and terms[at][0] < start:
            at += 1
        near = [t for _, _, t in terms[max(0, at - window):at + window]]
        yield entity(kind, text[start:end]), xxhash.xxh3_64_intdigest(" ".join(near).encode("utf-8", "surrogatepass")) >> 1, list(dict.fromkeys(near))


def _context_task(window: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [(e, c, d, t) for d, text in zip(part.column("row").to_pylist(), part.column("text")) for e, c, terms in contexts(text.as_py(), window) for t in terms]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 4, (pa.binary(), pa.int64(), pa.int64(), pa.string()))],
                                             ["entity", "context", "row", "term"])

    return run


def disclosing_terms(docs: DataFrame, window: int = WINDOW, min_contexts: int = MIN_CONTEXTS, least: float = GENERALISE, min_bits: float = MIN_BITS) -> DataFrame:
    """term, disclosure (the largest P(entity | term)), bits: the terms above the thresholds."""
    rows = docs.select("text", F.xxhash64("doc_id", "text").alias("row")).filter("text is not null")
    near = stage(rows.mapInArrow(_context_task(window), "entity binary, context long, row long, term string"), "contexts")
    pairs = near.groupBy("term", "entity", "context").agg(F.lit(1).alias("one")).groupBy("term", "entity").agg(F.count("*").alias("n")).filter(F.col("n") >= min_contexts)
    pairs = stage(pairs.select("term", "entity"), "pairs")
    schema = "term string, disclosure double, bits double"
    n_terms, size = pairs.agg(F.count("*"), F.coalesce(F.sum(F.length("term") + 64), F.lit(0))).first()
    if not n_terms:
        return docs.sparkSession.createDataFrame([], schema)
    # documents with the term near the entity, with the entity, with the term, and all
    both = (near.select("term", "entity", "row").distinct().join(small_side(pairs, n_terms, size // n_terms), ["term", "entity"])
            .groupBy("term", "entity").agg(F.count("*").alias("n_both")))
    entities = near.select("entity", "row").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    # a term's documents are counted before they meet the pairs; a row that is there c times counts as one cth
    copies = stage(rows.groupBy("row").agg(F.count("*").alias("copies")).filter("copies > 1"), "copies")
    again = rows.join(small_side(copies, copies.count(), 24), "row", "left")
    words = again.select("copies", F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)))).alias("term"))
    counts = words.groupBy("term", F.coalesce("copies", F.lit(1)).alias("copies")).agg(F.count("*").alias("n")).groupBy("term").agg(F.sum(F.expr("n div copies")).alias("n_term"))
    # no semi join: Spark would move it below the counts, where it hands on every word of every document
    terms = counts.join(small_side(pairs.select("term").distinct(), n_terms, size // n_terms), "term")
    total = rows.select("row").distinct().count()
    share = F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))
    return (both.join(entities, "entity").join(terms, "term")
            .select("term", share.alias("disclosure"), F.log2(share * total / F.col("n_entity")).alias("bits"))
            .filter((F.col("disclosure") >= least) & (F.col("bits") >= min_bits))
            .groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.max("bits").alias("bits")))


def _mark_task(reveals, remove: float):
    """Adds spans and the sanitised text; ``reveals(part)`` gives each row's term -> disclosure."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for part in parts:
            found, texts = [], []
            for text, known in zip(part.column("text"), reveals(part)):
                t = text.as_py() or ""
                spans = base_spans(t)
                if known:
                    spans = spans + [("term", s, e) for s, e, w in free_terms(t, spans) if w in known]
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                texts.append(sanitised(t, spans, known, remove) if text.is_valid else None)
            names = [n for n in part.schema.names if n != "_known"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(found, kind), pa.array(texts, pa.string())], [*names, "spans", "sanitised"])

    return run


def sanitised(text: str, spans, known: dict[str, float], remove: float = REMOVE) -> str:
    """The text with base spans and disclosing terms replaced; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < at:
            at = max(at, e)
            continue
        gone = kind == "term" and known[normal_term(text[s:e])] >= remove
        out += [text[at:s], "" if gone else f"[{kind.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, terms: DataFrame | None = None, remove: float = REMOVE) -> DataFrame:
    """Every column of ``docs``, spans (array of kind, start, end) and sanitised (replacing such columns).

    ``terms``: what ``disclosing_terms`` gave; computed from ``docs`` if left out.
    """
    spark = docs.sparkSession
    docs = docs.drop("spans", "sanitised")
    terms = stage(disclosing_terms(docs) if terms is None else terms, "terms")
    schema = docs.select("*", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>").alias("spans"), F.lit(None).cast("string").alias("sanitised")).schema
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 100), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        table = spark.sparkContext.broadcast({r["term"]: r["disclosure"] for r in terms.collect()})
        return docs.mapInArrow(_mark_task(lambda part: [table.value] * part.num_rows, remove), schema)
    # more terms than a task should hold: give each document those that stand in it
    rows = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    own = (rows.select("_row", F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)))).alias("term"))
           .join(terms, "term").select("_row", "term", "disclosure").distinct().groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("_known")))
    return rows.join(own, "_row", "left").drop("_row").mapInArrow(_mark_task(lambda part: [dict(x or ()) for x in part.column("_known").to_pylist()], remove), schema)


def op6_pii(spark, sf_dir):
    """Personal data in every whole text of documents."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "term")

    def joined(x):
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    out = sanitise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
