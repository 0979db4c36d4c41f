"""Posts: text files of `Key: Value` lines, a blank line and a body."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions.text import excerpt, front_matter, front_value, plain_text, post_body

# What Spark writes as %XX in the name of a folder.
_ESCAPED = r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]"
# The folder of rows without a value.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
# What a URI has as %XX.
_ILLEGAL = r"[\x00-\x20\x7f\"#%<>?\[\\\]^`{|}]"
# Marks a folder whose groups are whole.
_GROUPED = "_GROUPED"
# Bytes of the files that a task holds at a time.
BATCH_BYTES = 4_000_000


def _local_path(spark: SparkSession, path: str) -> str | None:
    """The path as files of this machine have it, None on another file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_post_files(raw: DataFrame, path: str, tasks: int) -> None:
    """Slug and raw text to a text file for each slug, in a folder slug=... of its own; rows of one slug share a file, a line end after each.

    Each task has a folder group=... around those of its slugs, so that folders are listed by many tasks, a group at a time. On a
    local file system tasks write with Python: Hadoop without its native library starts a process (chmod) for each folder and file.
    """
    spark = raw.sparkSession
    dealt, local = raw.select("slug", "raw").repartition(tasks, "slug"), _local_path(spark, path)
    if local is None:
        dealt.withColumn("group", F.spark_partition_id()).write.partitionBy("group", "slug").text(path)
        return
    escaped, no_value = re.compile(_ESCAPED), _NO_VALUE

    def run(batches):
        context, at, file, names = TaskContext.get(), None, None, None
        group = f"{local}/group={context.partitionId()}"

        def finish() -> None:
            if file:
                file.close()
                os.replace(*names)

        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for slug, text in zip(batch.column(0).to_pylist(), texts):
                folder = f"{group}/slug={escaped.sub(lambda m: f'%{ord(m[0]):02X}', slug) if slug else no_value}"
                if folder != at:
                    finish()
                    os.makedirs(folder, exist_ok=True)
                    # A file gets its name when it is whole; a task that runs again replaces it.
                    at, names = folder, (f"{folder}/.part-{context.taskAttemptId()}", f"{folder}/part-00000.txt")
                    file = open(names[0], "wb")
                file.write((text or b"") + b"\n")
        finish()
        yield pa.RecordBatch.from_pydict({"group": pa.array([context.partitionId()], pa.int32())})

    os.makedirs(local)
    dealt.sortWithinPartitions("slug").mapInArrow(run, "group int").count()
    open(f"{local}/{_GROUPED}", "w").close()


def _grouped_files(spark: SparkSession, local: str) -> DataFrame:
    """File and value of the posts that write_post_files wrote on a local file system: a task lists and reads a group.

    The driver knows the groups only, not every file.
    """
    groups, size, illegal = sorted(x for x in os.listdir(local) if x.startswith("group=")), BATCH_BYTES, re.compile(_ILLEGAL)

    def run(batches):
        files, values, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(values, pa.binary())], ["file", "value"])

        for group in (groups[i] for ids in batches for i in ids.column(0).to_pylist()):
            for folder in sorted(os.listdir(f"{local}/{group}")):
                for name in sorted(os.listdir(f"{local}/{group}/{folder}")):
                    if name.startswith((".", "_")):
                        continue
                    path = f"{local}/{group}/{folder}/{name}"
                    with open(path, "rb") as f:
                        values.append(f.read())
                    files.append("file://" + illegal.sub(lambda m: f"%{ord(m[0]):02X}", path))
                    held += len(values[-1])
                    if held >= size:
                        yield batch()
                        files, values, held = [], [], 0
        if files:
            yield batch()

    found = spark.range(0, len(groups), 1, max(1, len(groups))).mapInArrow(run, "file string, value binary")
    return found.select("file", F.col("value").cast("string").alias("value"))


def read_post_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; its slug is the file name without its ending, or the folder's where files lie in folders slug=..."""
    local = _local_path(spark, path)
    if local and os.path.exists(f"{local}/{_GROUPED}"):
        files = _grouped_files(spark, local)
    else:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    file = F.col("file")
    folder, name = F.regexp_extract(file, r"/slug=([^/]+)/[^/]*$", 1), F.element_at(F.split(file, "/"), -1)
    return files.select(
        F.coalesce(F.nullif(folder, F.lit("")), F.regexp_replace(name, r"\.md$", "")).alias("slug"), F.col("value").alias("raw")
    )


def parse_posts(raw: DataFrame) -> DataFrame:
    """Slug and raw text to title, date, author, body text and excerpt."""
    meta, body = front_matter("raw"), post_body("raw")

    def value(key: str, default: str) -> Column:
        return F.coalesce(front_value(F.col("_meta"), key), F.lit(default))

    text = plain_text("body")
    return raw.select("slug", meta.alias("_meta"), body.alias("body")).select(
        "slug", value("title", "Untitled").alias("title"), value("date", "").alias("date"),
        value("author", "").alias("author"), text.alias("text"),
        excerpt(front_value(F.col("_meta"), "excerpt"), text).alias("excerpt"),
    )


def by_slug(posts: DataFrame, slug: str) -> DataFrame:
    """The post of a slug, the newest should several files have it."""
    return newest(posts.filter(F.col("slug") == slug), 1)


def newest(posts: DataFrame, n: int | None = None) -> DataFrame:
    ordered = posts.orderBy(F.desc("date"), "slug")
    return ordered if n is None else ordered.limit(n)
