"""From raw documents to encoded training text: five stages, each of which runs on all its input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake import configure
from meterlake.llm import mixing, ngram_jaccard, quality, secret_scan, sentencepiece_fst
from meterlake.llm.texts import free_name
from meterlake.storage import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.7 or more); it learns from `labels`."""
    configure(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # Own columns of the names of results step aside for the while.
    aside = {c: free_name([*docs.columns, "score", "predicted"], f"own_{c}") for c in docs.columns if c.lower() in ("score", "predicted")}
    scored = quality.score(docs.withColumnsRenamed(aside), model, [aside.get(c, c) for c in docs.columns])
    return scored.filter("predicted = 1").select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five words, 0.8)."""
    configure(spark)
    return ngram_jaccard.keep_one(docs, ngram_jaccard.Rule(5, 80))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and `n_chars` set to the new length."""
    configure(spark)
    return secret_scan.redact(docs, secret_scan.train(docs))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at target weights: a row per copy taken."""
    configure(spark)
    return mixing.copies(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of every text."""
    configure(spark)
    return sentencepiece_fst.encode(docs, ["doc_id", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_join),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: SQL expresses neither the classifier nor the machine; see tests/llm for the brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is stored, read again by the next stage and then removed."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.store(docs, f"stage_{i + 1}")
    return scratch.release(docs)
