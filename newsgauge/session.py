"""Session helpers: settings that fit the workload, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Spark 4.1 and later: an execution's shuffle files go when it ends
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS_PER_TASK = 8192


def build_session(app: str = "newsgauge", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session; extra settings are passed with ``__`` standing for a dot."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    defaults.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as the session names it in spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder, because there the driver is the
    only machine; that folder goes when the process ends.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="newsgauge-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of the executor that computed them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_count(df: DataFrame) -> tuple[DataFrame, int]:
    """As cut_lineage, for plans of many steps: the rows and their number (a repeated task may count twice).

    The shuffle files behind the rows go at once, not when the driver happens to collect its garbage. Few rows are
    kept in few partitions, so that each later shuffle of them writes few files.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before, seen = spark.conf.get(CLEANUP, "false"), Observation()
    spark.conf.set(CLEANUP, "true")
    try:
        kept = df.observe(seen, F.count(F.lit(1)).alias("rows")).checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)
    rows = seen.get["rows"]
    parts = max(1, -(-rows // ROWS_PER_TASK))
    return kept.coalesce(parts) if parts < kept.rdd.getNumPartitions() else kept, rows


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, with its path, so that a loop can remove what it has replaced."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a table with fewer input splits than cores; larger tables stay as they are.

    Expensive text expressions over one small file would otherwise run in a single task. The check
    looks at the planned splits only, so a table of many files is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
