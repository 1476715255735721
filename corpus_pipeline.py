"""A training corpus from documents: rules, copies, benchmark passages, secrets, packing.

A stage takes the columns of documents, whatever others stand beside them, and each but
the last returns these columns alone. Null and empty texts fail the quality rules; in the
later stages they have nothing to lose and stay, and packing gives them the end id. Rows
that share an id are judged by their own texts, but of equal or similar texts only the
row or rows with the least id stay; rows without an id are never taken for copies. An
empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontamination, jaccard, packing, quality, secrets, tokens
from quire.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; the others lose the lines that recur across their host."""
    judged = quality.judge(docs.select(*COLUMNS), "text", "source", list(COLUMNS))
    return _measured(quality.clean(judged, "text"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by 5-word shingles at 0.8 or more, the one with the least id stays."""
    return jaccard.one_each(docs, k=5, percent=80).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to edits, go."""
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; no document goes."""
    return _measured(secrets.redact(secrets.scan(docs.select(*COLUMNS), "doc_id", "text"), "text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept text's ids, in sequences of 1024."""
    return packing.pack(docs, "doc_id", "text", tokens.vocabulary("byte_bpe_50k.json"))


def _measured(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", ngram_jaccard), ("benchmark decontamination", benchmark_passages), ("secret scans", secret_scan), ("packing", pack_sequences)]

#: Packing and decontamination have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = kept.keep(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
