"""The corpus pipeline: raw documents to a training mix, one operator a stage.

Every stage takes all rows that its predecessor kept, with the columns of ``documents``, and returns
them with the same columns; the last returns what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontam, langid, linededup, minhash, mixing
from riskloom.llm.common import read, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this share of the code lengths a language is no decision.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without text or letters, or without a clear winner, go."""
    docs = docs.select(COLUMNS)
    trees = langid.fit(langid.learnable(docs))
    found = langid.identify(docs, trees).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more that at least five documents share stay in the largest doc_id only."""
    out = linededup.dedup_lines(docs.select(COLUMNS), min_chars=40, min_docs=5)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return minhash.one_of_each(docs.select(COLUMNS), n=5, threshold=(80, 100)).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows hit no word, or less than one word in twenty."""
    return decontam.clean_documents(docs.select(COLUMNS), read(spark, sf_dir, "benchmark").select("item_id", "text")).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document that is left."""
    return mixing.taken_words(docs.select("doc_id", "text", "source"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
]

#: The first stage learns a model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each written as Parquet in the shared folder and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
