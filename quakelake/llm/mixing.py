"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakelake.llm.common import WORD, own_columns, stored, whole
from quakelake.llm.registry import query
from quakelake.operators.common import small_side

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
SEED = "mix-1"
#: Ranges of the sampling rank; a source is cut inside one of them.
RANKS = 4096
#: Order of a source's rows in its sample. Rows that agree in all three are interchangeable.
TIE = ("rank", "id", "size")


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def source_targets(
    totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """Add ``target`` to ``(source, source_size, n)``, one row per source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all
    sizes. A target stops at ``limit`` times its source's size and the excess is shared again by
    weight. In the order of limit over weight the stopped sources come first, so one running sum
    finds them all. The windows see one row per source, never documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("__place", place).withColumn(
        "__w", F.element_at(F.array(*map(F.lit, weights)), (F.col("__place") % len(weights) + 1).cast("int"))
    )
    top = F.col("source_size") * F.lit(limit)
    by_ratio = Window.orderBy(top / F.col("__w"), "__place")
    every = Window.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every) * F.lit(share)
    ranked = weighed.withColumns(
        {
            "__cap": top,
            "__budget": budget,
            "__level": (budget - F.coalesce(F.sum(top).over(before), F.lit(0))) / F.sum("__w").over(onward),
        }
    ).withColumn("__full", F.col("__level") * F.col("__w") >= F.col("__cap"))
    spent = F.coalesce(F.sum(F.when(F.col("__full"), F.col("__cap"))).over(every), F.lit(0))
    left = F.sum(F.when(~F.col("__full"), F.col("__w"))).over(every)
    target = F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise((F.col("__budget") - spent) / left * F.col("__w"))
    return ranked.withColumn("target", target).drop("__place", "__w", "__cap", "__budget", "__level", "__full")


def _ranked(sized: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """Add certain copies, the words still wanted and the Pareto rank of each document.

    Every document gets the whole part of target / source size as certain copies. The fraction f
    left over is the source's inclusion probability; a document's odds are f / (1 - f), tilted by
    the square root of its length over the mean length so that longer documents, which carry more
    of the words, are likelier to be repeated than short ones. Rank: random odds divided by
    inclusion odds.
    """
    joined = (
        sized.withColumnRenamed("source", "__source")
        .join(targets, F.col("__source").eqNullSafe(F.col("source")))
        .drop("__source")
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    code = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":" + seed))), 1, 13), 16, 10)
    u = (code.cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    joined = joined.withColumns({"copies": F.floor(ratio), "__u": u}).withColumn(
        "wanted", F.col("target") - F.col("copies") * F.col("source_size")
    )
    f = F.col("wanted") / F.col("source_size")
    some = (F.col("wanted") > 0) & (F.col("size") > 0)
    odds = f / (1 - f) * F.sqrt(F.col("size") / (F.col("source_size") / F.col("n")))
    joined = joined.withColumn("rank", F.when(some, F.col("__u") / (1 - F.col("__u")) / odds))
    piece = F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * RANKS), F.lit(RANKS - 1))
    return joined.withColumn("piece", piece).drop("__u")


def sampling_plan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED
) -> tuple[DataFrame, DataFrame]:
    """The narrow table ``(id, source, size)`` and one row per source: target, and where its sample ends.

    The sample of a source is the start of its documents in rank order, up to the words still
    wanted. Words per (source, rank range) are summed first; only the range that the cut falls in
    is ordered, so no task sees a whole source.
    """
    sized = stored(
        df.select(
            F.col(f"`{id_col}`").alias("id"),
            F.col(f"`{source_col}`").cast("string").alias("source"),
            words(F.col(f"`{text_col}`")).alias("size"),
        ),
        "sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = stored(source_targets(totals), "targets")
    ranked = _ranked(sized, small_side(targets), seed).filter(F.col("rank").isNotNull())
    pieces = ranked.groupBy("source", "piece").agg(F.sum("size").alias("held"), F.first("wanted").alias("wanted"))
    in_order = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("held").over(in_order), F.lit(0)))
    cut = pieces.filter("before <= wanted").groupBy("source").agg(F.max_by(F.struct("piece", "before"), "piece").alias("cut"))
    cut = cut.select(F.col("source").alias("__s"), F.col("cut.piece").alias("cut_piece"), F.col("cut.before").alias("before"))
    at_cut = ranked.join(small_side(cut), F.col("source").eqNullSafe(F.col("__s")) & (F.col("piece") == F.col("cut_piece")))
    # Rows of one id and size tie in the draw; what is wanted may end among them.
    ties = at_cut.groupBy("__s", "rank", "id", "size").agg(
        F.count("*").alias("rows"), F.first("before").alias("before"), F.first("wanted").alias("wanted")
    )
    within = Window.partitionBy("__s").orderBy(*TIE).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(within), F.lit(0))
    reached = F.floor((F.col("wanted") - F.col("__start")) / F.col("size") + 0.5)
    ends = (
        ties.withColumn("__start", start)
        .filter(F.col("__start") + F.col("size") / 2 <= F.col("wanted"))
        .withColumn("chosen", F.least(F.col("rows"), F.greatest(reached, F.lit(1))))
        .groupBy("__s")
        .agg(F.max(F.struct(*TIE, "rows", "chosen")).alias("last"))
    )
    limits = cut.select("__s", "cut_piece").join(ends.withColumnRenamed("__s", "__e"), F.col("__s").eqNullSafe(F.col("__e")), "left").drop("__e")
    plan = targets.join(limits, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    return sized, stored(plan, "mix-plan")


def _numbered(tied: DataFrame) -> DataFrame:
    """Add ``__nth``, from 1, to the rows of each source's split tie.

    Rows are numbered inside the partition of a table written for it and partitions by one running
    sum over their counts, so a tie of any size is never one task.
    """
    table = stored(tied.withColumn("__part", F.spark_partition_id()), "mix-ties")
    own = Window.partitionBy("source", "__part").orderBy(F.lit(0))
    before = Window.partitionBy("__source").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.groupBy(F.col("source").alias("__source"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    starts = starts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("__part") == F.col("__p"))
    numbered = table.withColumn("__own", F.row_number().over(own)).join(small_side(starts), same)
    return numbered.withColumn("__nth", F.col("__before") + F.col("__own")).drop("__part", "__own", "__source", "__p", "__before")


def taken(sized: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """Add ``copies`` of each document of ``(id, source, size)`` to take, its source's size and target.

    Where the sample ends among rows of one id and size, as many of them as are wanted are taken.
    """
    ranked = _ranked(sized, small_side(plan), seed)
    place, last = F.struct(*TIE), F.struct(*[F.col(f"last.{c}") for c in TIE])
    at_cut = F.col("piece") == F.col("cut_piece")
    some = F.coalesce(at_cut & place.eqNullSafe(last) & (F.col("last.chosen") < F.col("last.rows")), F.lit(False))
    more = (F.col("piece") < F.col("cut_piece")) | (at_cut & (place <= last))
    plain = ranked
    if not plan.filter("last.chosen < last.rows").isEmpty():
        plain = ranked.filter(~some).withColumn("__nth", F.lit(None).cast("long"))
        plain = plain.unionByName(_numbered(ranked.filter(some)))
        more = F.when(F.col("__nth").isNotNull(), F.col("__nth") <= F.col("last.chosen")).otherwise(more)
    copies = F.col("copies") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)
    return plain.withColumn("copies", copies).drop("wanted", "rank", "piece", "cut_piece", "last", "n", "__nth")


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED
) -> DataFrame:
    """``(id, source, size, source_size, target, copies, taken)`` for every document.

    Whole documents are taken, at most twice each, and each source's words end within half a
    document of its target. Null texts have size 0 and are never sampled beyond certain copies;
    null sources are one source, the last; rows that agree in source, id and size tie in the draw and
    are taken one by one, whichever come first. Long texts count whole. An empty table gives no rows;
    other columns are ignored. Two runs on the same rows agree.
    """
    sized, plan = sampling_plan(df, id_col, text_col, source_col, seed)
    out = taken(sized, plan, seed).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", "taken")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
l AS (SELECT *, sum(source_size) OVER () * 1.5e0 AS budget,
             (sum(source_size) OVER () * 1.5e0 - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / CAST(weight AS DOUBLE), place
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY 2 * source_size / CAST(weight AS DOUBLE), place
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, level * weight >= 2 * source_size AS is_full FROM l),
t AS (SELECT source, source_size, n,
             CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE)
                  ELSE (budget - coalesce(sum(2 * source_size) FILTER (is_full) OVER (), 0))
                       / sum(weight) FILTER (NOT is_full) OVER () * weight END AS target FROM f),
r AS (SELECT doc_id, d.source, size, source_size, target, n,
             CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies,
             (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1'), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, target - copies * source_size AS wanted FROM r),
k AS (SELECT *, CASE WHEN wanted > 0 AND size > 0 THEN
        u / (1 - u) / ((wanted / source_size) / (1 - (wanted / source_size)) * sqrt(size / (source_size / CAST(n AS DOUBLE)))) END AS rank FROM o),
c AS (SELECT *, coalesce(sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, size, source_size, target,
       CAST(size * (copies + CASE WHEN rank IS NOT NULL AND before + size / 2e0 <= wanted THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


@query("op10_mixing", OP10_SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    docs = own_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "text", "source"])
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
