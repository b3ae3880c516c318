"""Evidence tables: reading model output, de-duplication, conflicts, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakelake.functions import text as X
from quakelake.operators.common import SMALL_ROWS, collect_small, exploded, small_side

#: Shares that the partners of one key are dealt to when many records are asked for.
SHARES = 16

# Fields of an evidence record in model output and their defaults.
PAPER_FIELDS = {
    "observation": "", "data_type": "unspecified", "spatial_scale": "unspecified",
    "depth_range": "unspecified", "geological_structure": "unspecified", "interpretation": "",
    "confidence": "medium", "uncertainty": "", "assumptions": "", "limitations": "",
}
TOOL_FIELDS = {
    "observation": "", "source_type": "inference", "evidence_type": "text", "data_type": "other",
    "spatial_scale": "unspecified", "depth_range": "unspecified",
    "geological_structure": "unspecified", "interpretation": "", "alternative_interpretation": "",
    "assumption": "", "confidence": "medium", "uncertainty": "", "citation": "",
}
NO_OBSERVATION = ["", "unspecified", "n/a"]


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} string" for name in fields)


def evidence_id(parent: Column, observation: Column) -> Column:
    """MD5 of the parent id and the whole observation."""
    return F.md5(F.concat(parent, F.lit(":"), observation))


def read_paper_output(df: DataFrame, raw: str = "raw", parent: str = "chunk_id", source_text: str | None = None, shortest: int = 0) -> DataFrame:
    """One evidence record per answer: the outermost ``{...}`` as JSON, defaults for absent keys.

    Answers to source texts under ``shortest`` characters, without JSON, or without an observation are
    dropped.
    """
    body = F.regexp_extract(F.col(raw), r"(?s)\{.*\}", 0)
    kept = df if source_text is None else df.filter(F.length(X.strip(F.col(source_text))) >= shortest)
    parsed = kept.withColumn("__j", F.from_json(body, _ddl(PAPER_FIELDS)))
    cols = {n: F.coalesce(F.col(f"__j.{n}"), F.lit(v)) for n, v in PAPER_FIELDS.items()}
    obs = X.strip(cols["observation"])
    return parsed.filter(~F.lower(obs).isin(NO_OBSERVATION)).select(
        F.col(parent),
        evidence_id(F.col(parent).cast("string"), obs).alias("evidence_id"),
        obs.alias("observation"),
        *[c.alias(n) for n, c in cols.items() if n not in ("observation", "assumptions", "limitations")],
        F.concat(cols["assumptions"], F.lit(" | "), cols["limitations"]).alias("notes"),
    )


def read_tool_output(df: DataFrame, raw: str = "raw", parent: str = "call_id", shortest: int = 1) -> DataFrame:
    """Evidence records of a JSON list ``[...]`` in each answer; observations under ``shortest`` characters dropped."""
    body = F.regexp_extract(F.col(raw), r"(?s)\[.*\]", 0)
    listed = F.from_json(body, "array<struct<" + ", ".join(f"{n}:string" for n in TOOL_FIELDS) + ">>")
    items = exploded(df, [F.col(parent)], listed, "__j", "item_no")
    cols = {n: F.coalesce(F.col(f"__j.{n}"), F.lit(v)) for n, v in TOOL_FIELDS.items()}
    obs = X.strip(cols["observation"])
    return items.filter(F.length(obs) >= shortest).select(
        F.col(parent),
        "item_no",
        evidence_id(F.col(parent).cast("string"), obs).alias("evidence_id"),
        obs.alias("observation"),
        *[c.alias(n) for n, c in cols.items() if n != "observation"],
    )


def read_with(df: DataFrame, reader: Callable[[pd.DataFrame], pd.Series], raw: str = "raw") -> DataFrame:
    """Add the answers of a user-supplied reader (a frame of rows in, a series of texts out)."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{raw: reader(batch)})

    return df.mapInPandas(run, ", ".join([*fields, f"{raw} string"]))


def source_text(
    df: DataFrame, kind: str = "kind", shortest: int = 1, max_items: int | None = None, max_chars: int | None = None
) -> DataFrame:
    """Text of a tool output for a reader, by kind; texts under ``shortest`` characters dropped.

    ``max_items`` and ``max_chars`` shorten lists and the texts in them for display.

    Columns by kind: ``content`` string; ``chunks`` array of (doc_name, page, text); ``papers``
    array of (title, year, abstract); ``entries`` array of (snippet).
    """
    listed = lambda name: F.col(name) if max_items is None else F.slice(name, 1, max_items)
    options = []
    if "content" in df.columns:
        options.append((F.col(kind) == "content", X.head(F.col("content"), max_chars)))
    if "chunks" in df.columns:
        chunk = lambda c: F.concat(
            F.lit("["), F.coalesce(c["doc_name"], F.lit("?")), F.lit(" p"),
            F.coalesce(c["page"].cast("string"), F.lit("?")), F.lit("]\n"), X.head(F.coalesce(c["text"], F.lit("")), max_chars),
        )
        options.append((F.col(kind) == "chunks", F.array_join(F.transform(listed("chunks"), chunk), "\n\n")))
    if "papers" in df.columns:
        paper = lambda p: F.concat(
            F.lit("Title: "), F.coalesce(p["title"], F.lit("")), F.lit("  Year: "),
            F.coalesce(p["year"].cast("string"), F.lit("")), F.lit("  Abstract: "),
            X.head(F.coalesce(p["abstract"], F.lit("")), max_chars),
        )
        options.append((F.col(kind) == "papers", F.array_join(F.transform(listed("papers"), paper), "\n")))
    if "entries" in df.columns:
        options.append(
            (F.col(kind) == "entries", F.array_join(F.transform(listed("entries"), lambda e: F.coalesce(e["snippet"], F.lit(""))), "\n"))
        )
    shown = F.lit(None).cast("string")
    for test, value in reversed(options):
        shown = F.when(test, value).otherwise(shown)
    return df.withColumn("source_text", shown).filter(F.length(X.strip(F.col("source_text"))) >= shortest)


# --- merging ------------------------------------------------------------------------------------


def observation_key(observation: Column) -> Column:
    return F.md5(observation)


def new_evidence(incoming: DataFrame, table: DataFrame | None, order: str = "seq") -> DataFrame:
    """Incoming records whose observation is not in the table, each observation once (first wins).

    Records without an observation count as one observation: the first is kept, and none beside one
    that the table holds already.
    """
    others = list(incoming.columns)
    first = (
        incoming.withColumn("obs_key", observation_key(F.col("observation")))
        .groupBy("obs_key")
        .agg(F.min_by(F.struct(*others), F.col(order)).alias("__e"))
        .select("obs_key", "__e.*")
    )
    if table is None:
        return first
    # A table that holds the keys needs no text to be read again.
    key = F.col("obs_key") if "obs_key" in table.columns else observation_key(F.col("observation"))
    held = table.select(key.alias("__held"))
    return first.join(held, F.col("obs_key").eqNullSafe(F.col("__held")), "left_anti")


def _structure_key() -> Column:
    key = F.lower(X.strip(F.col("geological_structure")))
    return F.when((key != "") & (key != "unspecified"), key)


def conflict_groups(table: DataFrame) -> DataFrame:
    """Structures with at least two records and more than one interpretation.

    Interpretations are compared whole, in lower case; they differ exactly when the smallest and
    largest do, so no distinct count is needed.
    """
    seen = F.lower(F.coalesce("interpretation", F.lit("")))
    return (
        table.select(_structure_key().alias("conflict_key"), seen.alias("__i"))
        .filter(F.col("conflict_key").isNotNull())
        .groupBy("conflict_key")
        .agg(F.count("*").alias("n_members"), F.min("__i").alias("__lo"), F.max("__i").alias("__hi"))
        .filter((F.col("n_members") >= 2) & (F.col("__lo") != F.col("__hi")))
        .select("conflict_key", "n_members")
    )


def flag_conflicts(table: DataFrame) -> DataFrame:
    """Add ``conflict_key`` and ``n_conflicts`` (the other members of the key) to every record.

    The relation "conflicts with" is kept factored: two records conflict when they share a
    ``conflict_key``. Listing every partner beside every record would square a large group.
    """
    groups = small_side(conflict_groups(table)).withColumnRenamed("conflict_key", "__g")
    return (
        table.withColumn("__k", _structure_key())
        .join(groups, F.col("__k") == F.col("__g"), "left")
        .withColumn("conflict_key", F.col("__g"))
        .withColumn("n_conflicts", F.coalesce(F.col("n_members") - 1, F.lit(0)).cast("long"))
        .drop("__k", "__g", "n_members")
    )


def conflicts_of(flagged: DataFrame, asked: DataFrame) -> DataFrame:
    """Partners of the asked-for records: ``evidence_id, other_id``.

    The asked-for records are sent to the table while they are proven few, so no large group of
    partners is one key of a shuffle; more of them are joined, each key in ``SHARES`` shares of its
    partners. Pairs are as many as asked-for records times partners, so they are never shuffled:
    repeated records go before they meet, and records that share several keys meet by the least.
    """
    # Named in number, so that few bytes of records stay many tasks: their pairs are many.
    tasks = 4 * flagged.sparkSession.sparkContext.defaultParallelism
    flagged = flagged.filter(F.col("conflict_key").isNotNull()).select("evidence_id", "conflict_key")
    keyed = flagged.repartition(tasks, "evidence_id").groupBy("evidence_id").agg(F.sort_array(F.collect_set("conflict_key")).alias("__keys"))
    mine = keyed.join(asked.select("evidence_id"), "evidence_id", "left_semi")
    mine = mine.select("evidence_id", F.col("__keys").alias("__mine"), F.explode("__keys").alias("conflict_key"))
    others = keyed.select(F.col("evidence_id").alias("other_id"), "__keys", F.explode("__keys").alias("conflict_key"))
    rows = collect_small(mine, SMALL_ROWS)
    if rows is not None:
        met = others.join(F.broadcast(mine.sparkSession.createDataFrame(rows, mine.schema)), "conflict_key")
    else:
        shares = F.sequence(F.lit(0), F.lit(SHARES - 1))
        dealt = others.withColumn("__share", F.pmod(F.xxhash64("other_id"), F.lit(SHARES)).cast("int"))
        met = dealt.join(mine.withColumn("__share", F.explode(shares)), ["conflict_key", "__share"])
    alone = (F.size("__keys") == 1) | (F.size("__mine") == 1)
    least = F.when(alone, True).otherwise(F.col("conflict_key") == F.array_min(F.array_intersect("__keys", "__mine")))
    return met.filter((F.col("other_id") != F.col("evidence_id")) & least).select("evidence_id", "other_id")


def markdown_rows(flagged: DataFrame, obs_chars: int | None = None, interp_chars: int | None = None) -> DataFrame:
    """One Markdown table row per record; vertical bars in texts become a look-alike."""
    plain = lambda c, n: F.translate(X.head(F.col(c), n), "|", "∣")
    conflicts = F.when(
        F.col("n_conflicts") > 0,
        F.concat(F.col("n_conflicts").cast("string"), F.lit(" × "), F.col("conflict_key")),
    ).otherwise("—")
    row = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ", "evidence_id", "source", plain("observation", obs_chars), "data_type",
            "geological_structure", plain("interpretation", interp_chars), "confidence", conflicts,
        ),
        F.lit(" |"),
    )
    return flagged.select("evidence_id", row.alias("markdown"))


MARKDOWN_HEADER = (
    "| ID | Source | Observation | Data Type | Structure | Interpretation | Confidence | Conflicts |\n"
    "|---|---|---|---|---|---|---|---|"
)


def tool_markdown_rows(table: DataFrame, obs_chars: int | None = None, interp_chars: int | None = None) -> DataFrame:
    """The row with source type in place of conflicts."""
    plain = lambda c, n: F.translate(X.head(F.col(c), n), "|", "∣")
    row = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ", "evidence_id", "source", "data_type", "geological_structure",
            plain("observation", obs_chars), plain("interpretation", interp_chars), "confidence", "source_type",
        ),
        F.lit(" |"),
    )
    return table.select("evidence_id", row.alias("markdown"))


# --- hypotheses, sources, log -------------------------------------------------------------------


def evaluate_hypotheses(hypotheses: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Attach assessments: contradicted rejects, unassessed means insufficient data."""
    judged = evaluations.select("hypothesis_id", "assessment", "note")
    return hypotheses.join(judged, "hypothesis_id", "left").select(
        *[c for c in hypotheses.columns if c not in ("status", "notes")],
        F.coalesce("assessment", F.lit("insufficient_data")).alias("assessment"),
        F.when(F.col("assessment") == "contradicted", "rejected").otherwise(F.col("status")).alias("status"),
        F.when(F.coalesce("note", F.lit("")) != "", F.col("note"))
        .otherwise(F.col("notes") if "notes" in hypotheses.columns else F.lit(""))
        .alias("notes"),
    )


def stop_test(n_new: int, iteration: int, hypotheses: DataFrame | None = None) -> str | None:
    """Why an evidence loop ends after this iteration, or None.

    No new evidence, or exactly one active hypothesis and that of high confidence; never in the
    first iteration. Two counts reach the driver.
    """
    if iteration <= 1:
        return None
    if n_new == 0:
        return "no_new_evidence"
    if hypotheses is not None:
        active = hypotheses.filter(F.col("status") == "active").agg(
            F.count("*").alias("n"), F.count_if(F.col("confidence") == "high").alias("high")
        ).head()
        if active["n"] == 1 and active["high"] == 1:
            return "hypothesis_convergence"
    return None


def source_list(hits: DataFrame, name: str = "doc_name") -> DataFrame:
    """Distinct document names."""
    return hits.select(name).filter(F.col(name).isNotNull()).distinct()


def tool_log(calls: DataFrame, iteration: str = "iteration") -> DataFrame:
    """Calls, errors and seconds per iteration."""
    return calls.groupBy(iteration).agg(
        F.count("*").alias("n_calls"),
        F.count_if(F.col("error").isNotNull() & (F.col("error") != "")).alias("n_errors"),
        F.sum("duration_s").alias("seconds"),
    )


def evidence_points(evidence: DataFrame) -> DataFrame:
    """Located evidence: lon or longitude with lat or latitude; zero is a coordinate."""
    pick = lambda *names: F.coalesce(
        *[F.col(n).cast("double") for n in names if n in evidence.columns]
    )
    return (
        evidence.withColumn("longitude", pick("lon", "longitude"))
        .withColumn("latitude", pick("lat", "latitude"))
        .withColumn("source_type", F.coalesce("source_type", F.lit("inference")))
        .filter(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
        .drop("lon", "lat")
    )
