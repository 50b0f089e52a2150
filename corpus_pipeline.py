"""Cleans a corpus: quality rules, near-duplicates, benchmark leaks, secrets, then tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
it kept. All but the last return the columns of ``documents``.

Defined results: nulls in any column, empty and very long texts, repeated rows,
empty tables and extra columns give what the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pgspark.llm import bpe, decontaminate, quality, secrets, simhash
from pgspark.llm.common import discard, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a plain rule nor a distance to the language references rejects."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id. Sets of five-word shingles, Jaccard similarity 0.8 or more."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind; ``n_chars`` follows the text."""
    clean = secrets.redact(docs)
    if "n_chars" not in clean.columns:
        return clean
    return clean.select(*[F.length("text").cast(clean.schema[c].dataType).alias(c) if c == "n_chars" else c for c in clean.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of all documents."""
    import public_tokenizers

    found = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secret_scans", secret_scans),
    ("tokens", tokens),
]
#: Fingerprints and tokens cannot be written in SQL; tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(before)
    return docs
