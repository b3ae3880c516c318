"""Conversation logs: recent turns, rule-based labels, mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakelake.functions import text as X
from quakelake.operators.common import top_k


def recent_messages(df: DataFrame, n: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Last ``n`` messages of each conversation."""
    return top_k(df, [conv], [F.desc(turn)], n, "__r").drop("__r")


def recent_turns(df: DataFrame, n: int = 5, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Last ``n`` exchanges: two messages each."""
    return recent_messages(df, 2 * n, conv, turn)


def trimmed_history(df: DataFrame, n: int = 40, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """Last ``n`` messages without the tool messages that would lead them.

    A conversation of at most ``n`` messages is kept whole.
    """
    last = top_k(df, [conv], [F.desc(turn)], n + 1, "__r")
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    longer = F.max("__r").over(Window.partitionBy(conv)) > n
    flagged = last.withColumn("__long", longer).filter(~F.col("__long") | (F.col("__r") <= n))
    started = F.max(F.when(F.col(role) != "tool", 1).otherwise(0)).over(w) == 1
    return (
        flagged.withColumn("__started", started)
        .filter(~F.col("__long") | F.col("__started"))
        .drop("__r", "__long", "__started")
    )


def last_steps_context(df: DataFrame, n: int = 5, max_chars: int = 3000, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The last ``n`` step texts in order, joined by newlines and cut to ``max_chars``."""
    return (
        recent_messages(df, n, conv, turn)
        .groupBy(conv)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct(turn, text))), lambda s: s[text]).alias("__t"))
        .select(conv, X.head(F.array_join("__t", "\n"), max_chars).alias("context"))
    )


def label_scores(text: Column, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> Column:
    """Array of ``struct(score, label)`` in rule order: 1 per keyword contained, 2 per pattern found."""
    low = F.lower(text)
    scored = []
    for label, keywords, patterns in rules:
        points = F.lit(0)
        for word in keywords:
            points = points + F.contains(low, F.lit(word.lower())).cast("int")
        for pattern in patterns:
            points = points + low.rlike("(?U)" + pattern).cast("int") * 2
        scored.append(F.struct(points.alias("score"), F.lit(label).alias("label")))
    return F.array(*scored)


def label_messages(df: DataFrame, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]], text: str = "text") -> DataFrame:
    """Best label by rule score (first rule on ties) and confidence min(score / 5, 1).

    Messages that match nothing are ``unknown`` at 0. ``rules`` is a list of
    ``(label, keywords, patterns)``; the rules are part of the plan, so each message is read once.
    """
    if not rules:
        raise ValueError("no rules given")
    best = F.aggregate(
        label_scores(F.col(text), rules),
        F.struct(F.lit(0).alias("score"), F.lit("unknown").alias("label")),
        lambda acc, s: F.when(s["score"] > acc["score"], s).otherwise(acc),
    )
    return (
        df.withColumn("__b", best)
        .withColumn("label", F.col("__b.label"))
        .withColumn("confidence", F.least(F.col("__b.score") / F.lit(5.0), F.lit(1.0)))
        .drop("__b")
    )


def mentions(df: DataFrame, text: str = "text", model_patterns: list[str] | None = None) -> DataFrame:
    return df.withColumn("__m", X.entities(F.col(text), model_patterns)).select("*", "__m.*").drop("__m")
