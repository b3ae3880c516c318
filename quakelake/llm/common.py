"""Shared folder for intermediate tables, text normalisation, bounded membership filters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bits of a membership filter: 32,768 in each of 1,024 rows, 4 MB in all whatever the input.
FILTER_ROWS = 1024
FILTER_BITS = FILTER_ROWS * 32768

#: Bytes of a batch of rows on its way to a Python worker.
BATCH_BYTES = "4m"

_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
    return _local_dirs[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table made by ``stored`` that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: Sequence[str], name: str, to: str) -> tuple[DataFrame, int]:
    """Sort by ``order`` and number all rows from 0 in the column ``to``; also their count.

    Ranges are cut by value and, among equal rows, by a salt, so no value is one task. The table is
    written once; what each partition holds is one number on the driver per partition of the shuffle.
    """
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4096))
    keys = [F.col(c) for c in order]
    placed = df.withColumn("__salt", salt).repartitionByRange(*keys, F.col("__salt")).sortWithinPartitions(*keys).drop("__salt")
    table = stored(placed.withColumn("__at", F.monotonically_increasing_id()), name)
    part, local = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    total, starts = 0, []
    for number, rows in sorted(table.groupBy(part).count().collect()):
        starts.append((number, total))
        total += rows
    bases = df.sparkSession.createDataFrame(starts, "__part long, __base long")
    joined = table.join(F.broadcast(bases), part == F.col("__part"))
    return joined.withColumn(to, F.col("__base") + local).drop("__at", "__part", "__base"), total


def whole(text: Column | str) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def own_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the named columns, so that further ones cannot clash with those an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is handed at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def add_by_arrow(df: DataFrame, value: Column, name: str, kind: T.DataType, make: Callable) -> DataFrame:
    """Add the column ``name``, made from ``value`` batch by batch; one of that name is replaced.

    ``make()`` runs once per task and gives a function from an Arrow array to an Arrow array. The
    other columns pass through under any names. Batches are bounded in bytes, as texts can be long.
    """
    bounded_batches(df.sparkSession)
    others = [c for c in df.columns if c != name]
    base = df.select(*[F.col(f"`{c}`") for c in others], value.alias("__value"))
    base = base.toDF(*[f"c{i}" for i in range(len(others) + 1)])
    schema = T.StructType([*base.schema.fields[:-1], T.StructField("made", kind)])

    def run(batches):
        work = make()
        for batch in batches:
            columns = [*batch.columns[:-1], work(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "made"])

    return base.mapInArrow(run, schema).toDF(*others, name)


# --- membership filter --------------------------------------------------------------------------


def _bit(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))


def key_filter(keys: DataFrame, *key: Column) -> DataFrame:
    """A bitmap of the hashes of all keys: at most ``FILTER_ROWS`` rows of 4 KB.

    Its size does not depend on the number of keys, so it may be sent to every executor; when very
    many keys fill it, more rows pass ``may_hold`` and the exact step behind it has more to do.
    """
    bit = _bit(*key) + 1
    return keys.groupBy(F.bitmap_bucket_number(bit).alias("__slot")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("__bits")
    )


def may_hold(df: DataFrame, bitmap: DataFrame, name: str, *key: Column) -> DataFrame:
    """Add the boolean ``name``: false only if no key of the filter equals the row's key."""
    bit = _bit(*key)
    probed = df.withColumn("__bit", bit).join(
        F.broadcast(bitmap), F.bitmap_bucket_number(F.col("__bit") + 1) == F.col("__slot"), "left"
    )
    test = F.expr(
        "coalesce(shiftright(cast(conv(hex(substring(__bits, cast((__bit % 32768) div 8 + 1 as int), 1)), 16, 10) as int),"
        " cast(__bit % 8 as int)) % 2 = 1, false)"
    )
    return probed.withColumn(name, test).drop("__bit", "__slot", "__bits")


def kept_rows(df: DataFrame, stay: DataFrame, gone: DataFrame, keys: dict[str, Column], once: bool = False) -> DataFrame:
    """The rows of ``df`` whose keys are in ``stay``; ``gone`` holds the keys of dropped rows.

    Every row of ``df`` has its key in ``stay`` or ``gone``; a kept row that is missing in ``stay``
    would be lost where the filter of ``gone`` holds it by chance. With ``once`` rows whose keys are
    in both stay once.

    Rows that the filter of ``gone`` clears pass without moving; only the others, the dropped ones
    and a few more, meet ``stay`` in a join. ``keys`` gives the key columns of ``stay`` and ``gone``
    as expressions over ``df``; keys that are null match each other.
    """
    names = list(keys)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *[e.alias(f"__k_{n}") for n, e in keys.items()])
    probe = [F.coalesce(F.col(f"__k_{n}").cast("string"), F.lit("\0")) for n in names]
    held = [F.coalesce(F.col(n).cast("string"), F.lit("\0")) for n in names]
    marked = may_hold(packed, key_filter(gone, *held), "__maybe", *probe)
    unsure = marked.filter("__maybe")
    if once:
        unsure = unsure.dropDuplicates([f"__k_{n}" for n in names])
    test = None
    for n in names:
        same = F.col(f"__k_{n}").eqNullSafe(F.col(n))
        test = same if test is None else test & same
    sure = marked.filter("not __maybe")
    return sure.unionByName(unsure.join(stay.select(*names), test, "left_semi")).select("__row.*")
