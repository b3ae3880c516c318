"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results or plans; cluster sizing stays with the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Shuffles start with so many partitions at least; adaptive execution joins small ones. A fixed small
#: number would make each task's share, and its memory, grow with the input.
INITIAL_PARTITIONS = 512


def local_session(app: str = "quakelake", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the required SQL settings on a session that somebody else built."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get(initial, None) is None:
        spark.conf.set(initial, str(max(INITIAL_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return spark


_folders: dict[str, str] = {}


def local_folder(spark: SparkSession) -> str | None:
    """A temporary folder for a session whose tasks all run in this machine's one process, else None."""
    if not spark.sparkContext.master.startswith("local["):
        return None
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = "file://" + tempfile.mkdtemp(prefix="spark-work-")
    return _folders[app]


def cut_lineage(df: DataFrame, fallback_dir: str | None = None) -> DataFrame:
    """Checkpoint into the cluster's shared folder.

    The folder comes from ``spark.checkpoint.dir``; ``fallback_dir`` is used only when the cluster
    names none, as in tests.
    """
    spark = df.sparkSession
    directory = spark.conf.get("spark.checkpoint.dir", None) or fallback_dir
    if directory is None:
        raise ValueError("spark.checkpoint.dir is not set and no fallback folder was given")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(directory)
    return df.checkpoint(eager=True)
