"""From raw documents to training tokens: the stages, and a run of all of them.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept; the
result is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelake.llm.common import kept_rows, lower_ascii, stored, whole
from quakelake.llm.exact_dedup import exact_duplicates
from quakelake.llm.minhash import near_duplicates
from quakelake.llm.mixing import sampling_plan, taken, words
from quakelake.llm.sentencepiece import encode_pieces
from quakelake.llm.toxicity import THRESHOLD, fit_on_tables, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the threshold go."""
    scored = score_toxicity(docs, fit_on_tables(docs, sf_dir), "__toxicity")
    return scored.filter(F.col("__toxicity") < THRESHOLD).drop("__toxicity")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    digest = F.sha2(lower_ascii(whole("text")), 256)
    found = stored(exact_duplicates(docs.select("doc_id", "text", digest.alias("sha")), carry=["sha"]), "copies")
    keys = {"doc_id": F.col("doc_id"), "sha": digest}
    return kept_rows(docs, found.filter("kept"), found.filter("not kept"), keys, once=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their five-word shingles, the smallest id stays."""
    found = stored(near_duplicates(docs).select("doc_id", "kept"), "near")
    return kept_rows(docs, found.filter("kept"), found.filter("not kept"), {"doc_id": F.col("doc_id")})


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    _, plan = sampling_plan(docs)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("id"),
        "source",
        words(F.col("text")).alias("size"),
    )
    mixed = taken(rows, plan).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    return encode_pieces(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("pieces", tokens),
]

#: Scores of trained classifiers cannot be told in SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
