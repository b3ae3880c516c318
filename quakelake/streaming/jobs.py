"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelake.operators import documents as D
from quakelake.operators.evidence import new_evidence, observation_key


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder (a temporary one in local sessions)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Parquet tables of a folder whose names match, as a stream with the schema of the present ones.

    A table is one file or a folder of part files. The path is always a pattern, since a stream takes
    a plain path for a folder.
    """
    path = f"{folder.rstrip('/')}/{pattern}"
    if not any(c in pattern for c in "*?[{"):
        path = f"{path[:-1]}[{path[-1]}]"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Drain what is available into an append-only Parquet table and return that table."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/table")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def run_to_end(stream: DataFrame, time: str, build: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Drain a finite input through ``build`` and let its watermark pass everything: open windows come out too.

    What is available is drained first. One row beyond all times then moves the watermark on; its own
    window never closes. After that the progress folder takes no more rows.
    """
    spark = stream.sparkSession
    ends = f"{folder}/ends"
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields if f.name != time]
    last = spark.range(1).select(F.lit("9000-01-01").cast(stream.schema[time].dataType).alias(time), *nothing)
    last.limit(0).write.parquet(ends)
    both = build(stream.unionByName(spark.readStream.schema(last.schema).parquet(ends)))
    run_available(both, folder)
    last.write.mode("append").parquet(ends)
    return run_available(both, folder)


def run_batches(stream: DataFrame, folder: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Drain what is available through a batch function that may be called again for a batch."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


# --- rates and events ---------------------------------------------------------------------------


def rolling_rate(
    stream: DataFrame, window: str = "24 hours", lateness: str = "1 hour", keys: Sequence[str] = (), time: str = "time"
) -> DataFrame:
    """Events per fixed time window; a window is final once the watermark has passed its end."""
    return (
        stream.withWatermark(time, lateness)
        .groupBy(F.window(time, window).alias("w"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("bin_start"), F.col("w.end").alias("bin_end"), *keys, "n")
    )


def pick_sessions(
    stream: DataFrame, gap: str, keys: Sequence[str], lateness: str = "1 hour", min_phases: int = 1, min_p: int = 0, min_s: int = 0
) -> DataFrame:
    """Picks closer than a gap as one event per key (a region or network), with phase thresholds.

    Keys bound the state: a session window without keys would keep all sessions in one place.
    """
    if not keys:
        raise ValueError("session grouping needs at least one key")
    counted = (
        stream.withWatermark("abs_time", lateness)
        .groupBy(*keys, F.session_window("abs_time", gap).alias("w"))
        .agg(
            F.count("*").alias("n_phases"),
            F.count_if(F.startswith("phase", F.lit("P"))).alias("n_p"),
            F.count_if(F.startswith("phase", F.lit("S"))).alias("n_s"),
        )
    )
    return counted.filter(
        (F.col("n_phases") >= min_phases) & (F.col("n_p") >= min_p) & (F.col("n_s") >= min_s)
    ).select(*keys, F.col("w.start").alias("first"), "n_phases", "n_p", "n_s")


# --- evidence -----------------------------------------------------------------------------------


def new_observations(stream: DataFrame, time: str, horizon: str = "30 days") -> DataFrame:
    """First record of every observation; repeats within the horizon are dropped.

    State is bounded by the horizon: an observation that returns later counts as new.
    """
    return (
        stream.withWatermark(time, horizon)
        .withColumn("obs_key", observation_key(F.col("observation")))
        .dropDuplicatesWithinWatermark(["obs_key"])
    )


def merge_evidence(stream: DataFrame, store: str, folder: str, order: str = "seq") -> DataFrame:
    """Append arriving evidence whose observation is not in the table yet; returns the table.

    A batch compares itself with the other batches' partitions and overwrites its own, so running
    it again changes nothing. Of those it reads only the keys, and only the shares of the table that
    its own keys fall into. Partitions are named by the progress folder and the batch, so another
    run over the same store adds to it. Unlike :func:`new_observations` nothing is ever forgotten:
    the table itself is the memory.
    """
    path = f"{store}/evidence"

    def handle(batch: DataFrame, number: int) -> None:
        held = _stored(batch.sparkSession, path, "obs_key string, run string, batch int, share string")
        others = held.filter((F.col("run") != _run_of(folder)) | (F.col("batch") != number))
        touched = _touched(batch.select(_share(observation_key(F.col("observation"))).alias("share")))
        fresh = new_evidence(batch, others.filter(F.col("share").isin(touched)), order)
        shared = fresh.withColumn("share", _share(F.col("obs_key")))
        shared.write.mode("overwrite").partitionBy("share").parquet(_partition(path, folder, number))

    run_batches(stream, folder, handle)
    ddl = ", ".join(["obs_key string", *[f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema], "run string, batch int, share string"])
    return _stored(stream.sparkSession, path, ddl)


# --- indexing -----------------------------------------------------------------------------------


def _run_of(folder: str) -> str:
    """A name for all batches of one progress folder."""
    return "r" + hashlib.md5(folder.rstrip("/").encode()).hexdigest()[:16]


def _partition(path: str, folder: str, number: int) -> str:
    return f"{path}/run={_run_of(folder)}/batch={number}"


def _share(key: Column) -> Column:
    """One of sixteen shares of a store, by the first digit of a key's hash; keys that are null have one."""
    return F.concat(F.lit("s"), F.coalesce(F.substring(F.md5(key.cast("string")), 1, 1), F.lit("-")))


def _touched(shares: DataFrame) -> list[str]:
    """The shares that a batch falls into, seventeen at most."""
    return sorted(r["share"] for r in shares.distinct().collect())


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as exc:  # the store does not exist before its first batch
        if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def newest(manifest: DataFrame) -> DataFrame:
    """The last version of every document of a manifest."""
    others = [c for c in manifest.columns if c != "doc_id"]
    return manifest.groupBy("doc_id").agg(F.max_by(F.struct(*others), F.col("version")).alias("__m")).select("doc_id", "__m.*")


def index_documents(
    stream: DataFrame, store: str, folder: str, size: int = 500, overlap: int = 50, shortest: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Chunk arriving ``doc_id, text`` rows into a store; returns its manifest and its chunks as they now are.

    A document whose text is the one already indexed is skipped, told by a hash of the whole text. A
    changed text becomes the document's next version, whose chunks replace the earlier ones; a null
    text deletes the document. Every batch writes its own partition, named by progress folder and
    batch, and writes it again if it is retried; of the manifest it reads the shares that its own ids
    fall into. So a lost executor, a restart or another run over the store leaves no duplicates and
    loses nothing. Documents that give no chunk are recorded as failed and tried again when they
    arrive again.
    """
    spark = stream.sparkSession
    id_type = stream.schema["doc_id"].dataType.simpleString()
    manifest_ddl = f"doc_id {id_type}, text_hash string, version long, n_chunks long, status string, error string, run string, batch int, share string"
    manifest_path, chunk_path = f"{store}/manifest", f"{store}/chunks"

    def handle(batch: DataFrame, number: int) -> None:
        held = _stored(batch.sparkSession, manifest_path, manifest_ddl)
        others = held.filter((F.col("run") != _run_of(folder)) | (F.col("batch") != number))
        touched = _touched(batch.select(_share(F.col("doc_id")).alias("share")))
        known = newest(others.filter(F.col("share").isin(touched))).select("doc_id", F.col("text_hash").alias("old_hash"), F.col("version").alias("old"), F.col("status").alias("was"))
        # The smallest of several texts of one id: the same one whenever the batch is run.
        arrived = batch.groupBy("doc_id").agg(F.min("text").alias("text")).withColumn("text_hash", F.sha2("text", 256))
        same = F.col("old_hash").eqNullSafe(F.col("text_hash")) & F.col("was").isin("indexed", "deleted")
        absent = F.col("text").isNull() & F.col("was").isNull()
        fresh = (
            arrived.join(known, "doc_id", "left")
            .filter(~F.coalesce(same, F.lit(False)) & ~absent)
            .select("doc_id", "text", "text_hash", (F.coalesce("old", F.lit(0)) + 1).alias("version"))
        )
        chunk_folder = _partition(chunk_path, folder, number)
        pieces = D.chunk_sections(fresh.withColumn("page", F.lit(0).cast("long")), "doc_id", size, overlap, shortest)
        pieces.join(fresh.select("doc_id", "version"), "doc_id").write.mode("overwrite").parquet(chunk_folder)
        counted = batch.sparkSession.read.parquet(chunk_folder).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
        status = F.when(F.col("text").isNull(), "deleted").when(F.col("n_chunks") > 0, "indexed").otherwise("failed")
        fresh.join(counted, "doc_id", "left").select(
            "doc_id",
            "text_hash",
            "version",
            F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"),
            status.alias("status"),
            F.when(status == "failed", "no text extracted").otherwise("").alias("error"),
            _share(F.col("doc_id")).alias("share"),
        ).write.mode("overwrite").partitionBy("share").parquet(_partition(manifest_path, folder, number))

    run_batches(stream, folder, handle)
    manifest = newest(_stored(spark, manifest_path, manifest_ddl)).drop("share")
    current = manifest.filter("status = 'indexed'").select("doc_id", "version")
    chunks = spark.read.parquet(chunk_path).join(current, ["doc_id", "version"], "left_semi")
    return manifest.drop("run", "batch"), chunks.drop("run", "batch", "version")
