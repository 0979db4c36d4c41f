"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does the size checks: joins turn to broadcast only below the threshold
# measured after the shuffle, hot partitions are split, small ones merged.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "tenderlake", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ADAPTIVE, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def folder_state(spark: SparkSession, folder: str) -> str:
    """A folder with size and time of its entries: another text once a table in it is replaced."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    entries = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    found = sorted(f"{e.getPath().getName()} {e.getLen()} {e.getModificationTime()}" for e in entries)
    return "\n".join([folder, *found])


# Folder of a local session that names none, by application.
_LOCAL: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder of `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = context.applicationId
        root = _LOCAL.setdefault(app, "") or tempfile.mkdtemp(prefix="tenderlake-")
        _LOCAL[app] = root
    return f"{root.rstrip('/')}/tenderlake/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a step into the shared scratch folder and read it back: computed once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
