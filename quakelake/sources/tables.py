"""Small tables beside catalogs: stations, velocity models, mechanisms, faults, BibTeX, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakelake.functions import text as X
from quakelake.operators.common import join_keys
from quakelake.sources.picks import read_lines


def _fields(lines: DataFrame) -> DataFrame:
    """Data lines split at commas or white space."""
    bare = X.strip(F.col("line"))
    return (
        lines.withColumn("bare", bare)
        .filter((F.col("bare") != "") & ~F.startswith("bare", F.lit("#")))
        .withColumn("p", F.split("bare", r"\s*,\s*|\s+"))
    )


def _num(i: int) -> Column:
    return F.get("p", F.lit(i)).try_cast("double")


def parse_stations(lines: DataFrame) -> DataFrame:
    """``NET STA LOC lon lat elev`` lines; lines without readable coordinates are skipped."""
    p = lambda i: F.get("p", F.lit(i))
    return (
        _fields(lines)
        .select(
            p(0).alias("network"), p(1).alias("code"), p(2).alias("location"),
            F.concat_ws(".", p(0), p(1)).alias("station"),
            _num(3).alias("longitude"), _num(4).alias("latitude"), F.coalesce(_num(5), F.lit(0.0)).alias("elevation"),
        )
        .filter(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
    )


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return parse_stations(read_lines(spark, path))


def parse_velocity_model(lines: DataFrame) -> DataFrame:
    """``depth vp vs [density]`` lines; header lines are skipped."""
    return (
        _fields(lines)
        .select(_num(0).alias("depth"), _num(1).alias("vp"), _num(2).alias("vs"), _num(3).alias("density"))
        .filter(F.col("depth").isNotNull() & F.col("vp").isNotNull())
    )


def read_velocity_model(spark: SparkSession, path: str) -> DataFrame:
    return parse_velocity_model(read_lines(spark, path)).orderBy("depth")


def read_mechanisms(spark: SparkSession, path: str) -> DataFrame:
    """Focal mechanisms: all columns of a CSV with a header, numbers inferred by cast."""
    raw = spark.read.option("header", True).option("comment", "#").csv(path)
    numeric = {"strike", "dip", "rake", "mrr", "mtt", "mpp", "mrt", "mrp", "mtp", "lon", "lat", "longitude", "latitude", "depth", "mag", "magnitude", "mw"}
    return raw.select(
        *[
            (F.col(f"`{c}`").try_cast("double") if c.strip().lower() in numeric else F.col(f"`{c}`")).alias(c.strip())
            for c in raw.columns
        ]
    )


def fault_points(lines: DataFrame) -> DataFrame:
    """``path, segment, pos, lon, lat`` of polyline files; a blank or ``>`` line starts a segment.

    Breaks are counted inside each split of a file and offset by the splits before it.
    """
    bare = X.strip(F.col("line"))
    marked = lines.withColumn("bare", bare).withColumn(
        "__brk", F.when((F.col("bare") == "") | F.startswith("bare", F.lit(">")), 1).otherwise(0)
    )
    inner = Window.partitionBy("path", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        marked.groupBy("path", "block")
        .agg(F.sum("__brk").alias("n"))
        .withColumn("__before", F.coalesce(F.sum("n").over(outer), F.lit(0)))
        .drop("n")
    )
    numbered = join_keys(marked.withColumn("__local", F.sum("__brk").over(inner)), before, ["path", "block"])
    p = F.split("bare", r"\s*,\s*|\s+")
    return (
        numbered.filter((F.col("__brk") == 0) & ~F.startswith("bare", F.lit("#")))
        .select(
            "path",
            (F.col("__local") + F.col("__before")).cast("long").alias("segment"),
            "block",
            "pos",
            F.get(p, F.lit(0)).try_cast("double").alias("lon"),
            F.get(p, F.lit(1)).try_cast("double").alias("lat"),
        )
        .filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    )


def fault_segments(points: DataFrame) -> DataFrame:
    """Straight pieces ``segment_id, lon1, lat1, lon2, lat2`` between successive points of a polyline."""
    w = Window.partitionBy("path", "segment").orderBy("block", "pos")
    after = points.withColumn("__n", F.lead(F.struct("lon", "lat")).over(w)).withColumn("__i", F.row_number().over(w))
    return after.filter(F.col("__n").isNotNull()).select(
        F.xxhash64("path", "segment", "__i").alias("segment_id"),
        F.col("lon").alias("lon1"), F.col("lat").alias("lat1"),
        F.col("__n.lon").alias("lon2"), F.col("__n.lat").alias("lat2"),
    )


def read_faults(spark: SparkSession, path: str) -> DataFrame:
    return fault_segments(fault_points(read_lines(spark, path)))


# --- texts --------------------------------------------------------------------------------------


def read_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole files: ``path, text``."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def bibtex_entries(texts: DataFrame, query: str | None = None, limit: int | None = None, width: int | None = None) -> DataFrame:
    """Entries of BibTeX texts containing the query, with key and text (``width`` characters of it, if given)."""
    entry = F.explode(F.split(F.concat(F.lit("\n"), "text"), "\n@"))
    found = texts.select("path", entry.alias("entry"))
    if query is not None:
        found = found.filter(F.contains(F.lower("entry"), F.lit(query.lower())))
    key = F.regexp_extract("entry", r"^\w+\{(\S+),", 1)
    shown = found.select(
        "path",
        F.when(key != "", key).otherwise("?").alias("key"),
        F.concat(F.when(F.startswith("entry", F.lit("@")), "").otherwise("@"), X.strip(X.head(F.col("entry"), width))).alias("snippet"),
    )
    return shown if limit is None else shown.orderBy("path", "key", "snippet").limit(limit)


# The front-matter block and its list fields.
FRONT_MATTER = r"(?s)^---\s*\n(.*?)\n---\s*\n(.*)$"
LIST_FIELDS = ["keywords", "rag_sources", "related_skills"]


def _list_of(raw: Column) -> Column:
    """Items of a comma list, optionally in brackets, without quotes."""
    body = F.btrim(raw, F.lit(" []"))
    return F.filter(
        F.transform(F.split(body, ","), lambda x: F.btrim(x, F.lit(" \"'\t"))), lambda x: x != ""
    )


def front_matter(texts: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Metadata fields and body of texts that open with a ``---`` block.

    Scalar fields lose surrounding quotes; list fields come from ``a, b`` or from ``- a`` lines.
    Texts without a block keep their whole text as body and NULL fields.
    """
    fields = fields or ["name", "description", "category", "source", "workflow"]
    meta = F.regexp_extract("text", FRONT_MATTER, 1)
    has = F.col("text").rlike(FRONT_MATTER)

    def scalar(name: str) -> Column:
        got = F.regexp_extract(F.col("__m"), rf"(?m)^{name}:[ \t]*(.*)$", 1)
        return F.when(got != "", F.btrim(X.strip(got), F.lit("\"'")))

    def listed(name: str) -> Column:
        inline = _list_of(F.regexp_extract(F.col("__m"), rf"(?m)^{name}:[ \t]*(\S.*)$", 1))
        block = F.regexp_extract(F.col("__m"), rf"(?m)^{name}:[ \t]*((?:\n[ \t]+- .*)+)", 1)
        items = F.transform(
            F.regexp_extract_all(block, F.lit(r"\n[ \t]+- (.*)"), 1), lambda x: F.btrim(x, F.lit(" \"'\t"))
        )
        return F.when(F.size(inline) > 0, inline).otherwise(items)

    described = lambda n, c: F.regexp_replace(c, r"\s+", " ") if n == "description" else c
    return (
        texts.withColumn("__m", F.when(has, meta).otherwise(""))
        .withColumn("body", X.strip(F.when(has, F.regexp_extract("text", FRONT_MATTER, 2)).otherwise(F.col("text"))))
        .withColumns({n: described(n, scalar(n)) for n in fields})
        .withColumns({n: listed(n) for n in LIST_FIELDS})
        .drop("__m")
    )


def workflow_steps(texts: DataFrame, name: str = "name") -> DataFrame:
    """Steps of workflow texts: ``name, step_no, id, skill, description, depends_on``.

    A step is a ``- id:`` item of the ``steps:`` list with its indented fields.
    """
    meta = F.regexp_extract("text", FRONT_MATTER, 1)
    block = F.regexp_extract(meta, r"(?m)^steps:[ \t]*((?:\n[ \t].*)+)", 1)
    pieces = F.split(block, r"\n[ \t]+- (?=id:)")
    items = F.slice(pieces, F.lit(2), F.size(pieces))
    one = lambda f: F.btrim(F.regexp_extract(F.col("s"), rf"(?m)(?:^|\n)[ \t]*{f}:[ \t]*(.*)$", 1), F.lit(" \"'"))
    return texts.select(name, F.posexplode(items).alias("n", "s")).select(
        name,
        F.col("n").cast("long").alias("step_no"),
        one("id").alias("id"),
        one("skill").alias("skill"),
        one("description").alias("description"),
        _list_of(one("depends_on")).alias("depends_on"),
    )
