"""Exact duplicates by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelake.llm.common import key_filter, lower_ascii, may_hold, own_columns, whole
from quakelake.llm.registry import query

PREFIX_CHARS = 64


def exact_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """One row per input row: id, carried columns, ``keep_id``, ``group_size``, ``kept``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
    row with the largest id stays. Three passes refine the candidates: lengths that occur once are
    done; among the others (length, prefix hash) pairs that occur once are done; only the rest has
    its whole text hashed. Survivors of a pass are handed to the next scan as a filter of fixed
    size, so no text is shuffled and a false positive only costs one more hash.

    Null ids: such a row stays only if its group has no other id. Repeated rows (same id and text):
    each is counted, one stays. An empty table gives no rows. Other columns are ignored unless
    carried.
    """
    text = whole(f"`{text_col}`")
    rows = df.select(
        F.col(f"`{id_col}`").alias("__id"),
        *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)],
        text.alias("__text"),
        F.octet_length(text).alias("__bytes"),
    )
    lengths = rows.groupBy("__bytes").count().filter("count > 1")
    same_length = key_filter(lengths, F.col("__bytes"))
    rows = may_hold(rows, same_length, "__s1", F.col("__bytes"))
    prefix = F.when(F.col("__s1"), F.xxhash64(lower_ascii(F.substring("__text", 1, PREFIX_CHARS))))
    rows = rows.withColumn("__prefix", prefix)
    prefixes = rows.filter("__s1").groupBy("__bytes", "__prefix").count().filter("count > 1")
    same_prefix = key_filter(prefixes, F.col("__bytes"), F.col("__prefix"))
    rows = may_hold(rows, same_prefix, "__s2", F.col("__bytes"), F.col("__prefix"))
    # Length and prefix identify a text that the first two passes have settled.
    full = F.when(F.col("__s1") & F.col("__s2"), F.sha2(lower_ascii(F.col("__text")), 256))
    settled = F.concat_ws(":", F.col("__bytes"), F.coalesce(F.col("__prefix").cast("string"), F.lit("-")))
    carried = [f"__c{i}" for i in range(len(carry))]
    keyed = rows.select("__id", *carried, F.coalesce(full, settled).alias("__key"))
    per_id = keyed.groupBy("__key", "__id", *carried).agg(F.count("*").alias("__n"))
    groups = per_id.groupBy("__key").agg(F.max("__id").alias("keep_id"), F.sum("__n").alias("group_size"))
    firsts = per_id.join(groups, "__key")
    copies = firsts.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    return copies.select(
        F.col("__id").alias(id_col),
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)],
        "keep_id",
        "group_size",
        (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 1)).alias("kept"),
    )


OP1_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


@query("op1_exact_dedup", OP1_SQL)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicate groups of all documents with the digest of the normalised text."""
    docs = own_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "text"])
    hashed = docs.withColumn("text_sha256", F.sha2(lower_ascii(whole("text")), 256))
    return exact_duplicates(hashed, carry=["text_sha256"])
