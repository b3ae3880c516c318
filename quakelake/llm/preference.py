"""Preference pairs: shared turns rendered once as prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelake.llm.common import own_columns
from quakelake.llm.registry import query

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
TRAINED_ROLE = "assistant"


def plain(text: Column) -> Column:
    """Text that cannot pass for a turn marker: a blank parts every ``<|``."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), plain(turn["role"]), F.lit("\n"))


def body(turn: Column) -> Column:
    return F.concat(plain(turn["text"]), F.lit(CLOSE))


def segments(turns: Column) -> Column:
    """Per turn its header, never trained on, and its body, trained on when the assistant speaks."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(header(t).alias("text"), F.lit(False).alias("loss")),
                F.struct(body(t).alias("text"), (t["role"] == TRAINED_ROLE).alias("loss")),
            ),
        )
    )


def rendered(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def loss_chars(parts: Column) -> Column:
    sizes = F.transform(F.filter(parts, lambda s: s["loss"]), lambda s: F.length(s["text"]))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n)


def preference_pairs(
    turns: DataFrame, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per pair: ``n_prefix``, ``prompt``, ``chosen`` and ``rejected`` as segments, ``complete``.

    ``pair`` is the pair of a turn and ``chosen`` tells the chosen conversation from the rejected
    one. Turns go by number, then role, then text. The longest run of opening turns that agree in
    role and text is the prompt; each side's remaining turns are its completion, an array of
    (text, loss) in order, so masks hold for texts of any length. A row of the result holds the two
    conversations of one pair, and no more.

    Repeated turns count once. A null role is ``user``, a null text empty. Turns without a pair are
    left out. A pair with one side has no prefix, the other side is empty, and ``complete`` is
    false. Pairs whose sides are equal have two empty completions. An empty table gives no rows;
    other columns are ignored.
    """
    rows = turns.select(
        pair.alias("pair_id"),
        chosen.alias("__chosen"),
        F.struct(
            F.col(f"`{turn_col}`").alias("turn"),
            F.coalesce(F.col(f"`{role_col}`"), F.lit("user")).alias("role"),
            F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        ).alias("__turn"),
    ).filter(F.col("pair_id").isNotNull() & F.col("__chosen").isNotNull())
    sides = rows.groupBy("pair_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("__chosen"), F.col("__turn")))).alias("a"),
        F.array_sort(F.collect_set(F.when(~F.col("__chosen"), F.col("__turn")))).alias("b"),
    )
    both = F.zip_with("a", "b", lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    parts_at = F.array_position(F.transform(both, lambda same: F.coalesce(same, F.lit(False))), False)
    n_prefix = F.when(parts_at > 0, parts_at - 1).otherwise(F.size("a")).cast("int")
    sides = sides.withColumn("n_prefix", n_prefix)
    rest = F.lit(2**31 - 1) - F.col("n_prefix")
    return sides.select(
        "pair_id",
        "n_prefix",
        rendered(segments(F.slice("a", F.lit(1), F.col("n_prefix")))).alias("prompt"),
        segments(F.slice("a", F.col("n_prefix") + 1, rest)).alias("chosen"),
        segments(F.slice("b", F.col("n_prefix") + 1, rest)).alias("rejected"),
        ((F.size("a") > 0) & (F.size("b") > 0)).alias("complete"),
    )


OP4_SQL = """
WITH d AS (SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS side, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS pos,
             '<|turn|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS part,
             CASE WHEN role = 'assistant' THEN length(replace(text, '<|', '< |')) + 8 ELSE 0 END AS loss FROM d),
m AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos,
             a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
      FROM (FROM t WHERE side) a FULL JOIN (FROM t WHERE NOT side) b ON a.pair_id = b.pair_id AND a.pos = b.pos),
n AS (SELECT pair_id, CAST(coalesce(min(pos) FILTER (NOT same) - 1, max(pos)) AS INT) AS n_prefix FROM m GROUP BY pair_id)
SELECT pair_id, n_prefix,
       coalesce(string_agg(part, '' ORDER BY pos) FILTER (side AND pos <= n_prefix), '') AS prompt,
       coalesce(string_agg(part, '' ORDER BY pos) FILTER (side AND pos > n_prefix), '') AS chosen,
       coalesce(string_agg(part, '' ORDER BY pos) FILTER (NOT side AND pos > n_prefix), '') AS rejected,
       CAST(coalesce(sum(loss) FILTER (side AND pos > n_prefix), 0) AS BIGINT) AS chosen_loss_chars,
       CAST(coalesce(sum(loss) FILTER (NOT side AND pos > n_prefix), 0) AS BIGINT) AS rejected_loss_chars,
       bool_or(side) AND bool_or(NOT side) AS complete
FROM t JOIN n USING (pair_id) GROUP BY pair_id, n_prefix
"""


@query("op4_preference", OP4_SQL)
def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as pairs: of two following ids the even one is chosen, the odd one rejected."""
    turns = own_columns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), ["conv_id", "turn", "role", "text"])
    pairs = preference_pairs(turns, F.floor(F.col("conv_id") / 2), F.pmod(F.col("conv_id"), F.lit(2)) == 0)
    return pairs.select(
        "pair_id",
        "n_prefix",
        "prompt",
        rendered(F.col("chosen")).alias("chosen"),
        rendered(F.col("rejected")).alias("rejected"),
        loss_chars(F.col("chosen")).alias("chosen_loss_chars"),
        loss_chars(F.col("rejected")).alias("rejected_loss_chars"),
        "complete",
    )
