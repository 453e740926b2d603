"""A corpus pipeline: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.llm import near, quality, queries, secrets, suffix, tokens
from tidemeter.llm.common import table


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars as their texts are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more stay, as they are."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where("fm_score >= 0.7").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (0.8 or more of their five-word shingles in common) one row stays: the smallest id, of equal ids the first text; documents without an id stay."""
    return near.first_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat a smaller document's go; a character cut in two goes whole. Documents stay, if empty too."""
    # numbered meanwhile, as a column may be called like one of the operator's
    others = {c: f"_c{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    held = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in others.items()])
    left = suffix.without_repeats(held, others=tuple(others.values()), as_text=True)
    back = left.select("doc_id", F.col("kept").alias("text"), *[F.col(n).alias(c) for c, n in others.items()])
    return (_counted(back) if "n_chars" in others else back).select(*[f"`{c}`" for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return _counted(secrets.redacted(docs)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 tokens."""
    return queries.packed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: A learned score and byte-level suffixes are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = tokens.scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
