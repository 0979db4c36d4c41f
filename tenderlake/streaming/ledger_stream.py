"""New ledger rows from a stream into the partitioned ledger and its monthly rollup.

The checkpoint plays the part of the progress file: a run takes what is new and ends; a failed
batch leaves the state as it was and is repeated.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions.money import amount
from tenderlake.sources.landing import stream_landing
from tenderlake.sources.ledger import SCHEMA, with_fiscal_year, write_ledger

NO_YEAR = 0
# Batches of the monthly rollup that are folded into one.
FOLD = 16
# Partitions of a batch that a task gathers.
GATHERED = 50


def write_batch(batch: DataFrame, target: str, name: str) -> None:
    """The rows of a batch into its own folders of the ledger; a repeated batch replaces them."""
    write_ledger(batch, target, "overwrite", name)


def write_pages(batch: DataFrame, target: str, name: str) -> None:
    """A batch of many small partitions, as a paged interface gives: tasks take GATHERED of them each, so that the rows are
    written in few files without being shuffled. A small batch keeps a task for each core."""
    parts, cores = batch.rdd.getNumPartitions(), batch.sparkSession.sparkContext.defaultParallelism
    write_ledger(batch.coalesce(max(-(-parts // GATHERED), min(parts, cores))), target, "overwrite", name, rebalance=False)


def ingest(spark: SparkSession, landing: str, target: str, checkpoint: str, fmt: str = "csv",
           schema=SCHEMA, timeout: int | None = None, write: Callable[[DataFrame, str, str], None] = write_batch) -> bool:
    """Append all new rows of a landing folder to the ledger, by the fiscal year of the row."""
    return ingest_stream(stream_landing(spark, landing, fmt, schema), target, checkpoint, timeout, write)


def ingest_stream(rows: DataFrame, target: str, checkpoint: str, timeout: int | None = None,
                  write: Callable[[DataFrame, str, str], None] = write_batch) -> bool:
    """Append all new rows of a stream to the ledger, by the fiscal year of the row.

    Every batch has folders of its own, (fiscal year, batch), which Spark replaces as a whole. A batch that broke half way
    is repeated under the same name, so nothing is counted twice; bulk loads share the ledger under a batch of theirs.
    """
    spark = rows.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        write(batch, target, f"{_query_id(spark, checkpoint)}-{batch_id:06d}")

    query = (
        with_fiscal_year(rows).withColumn("fiscal_year", F.coalesce("fiscal_year", F.lit(NO_YEAR))).writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    return _finish(query, timeout)


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that owns a checkpoint; another checkpoint has another one."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def maintain_monthly(spark: SparkSession, landing: str, rollup: str, checkpoint: str, fmt: str = "csv",
                     schema=SCHEMA, timeout: int | None = None, fold: int = FOLD, files_per_trigger: int | None = 1000) -> bool:
    """Keep monthly totals current.

    Every batch writes its own few month rows under its query and batch number. A repeated batch
    overwrites them, so nothing is counted twice, and no state has to be kept. Every `fold` batches
    become one, so the number of files stays bounded. Another checkpoint is another query and adds its own batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{rollup.rstrip('/')}/query={_query_id(spark, checkpoint)}"
        batch.groupBy(F.substring("issue_date", 1, 7).alias("month")).agg(
            F.sum(amount("check_amount")).alias("amount"), F.count("*").alias("tx_count")
        ).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        if (batch_id + 1) % fold == 0:
            fold_months(spark, folder, batch_id)

    query = (
        stream_landing(spark, landing, fmt, schema, files_per_trigger).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    return _finish(query, timeout)


def _entries(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(e.getPath().getName() for e in files.listStatus(path)) if files.exists(path) else []


def _parts(spark: SparkSession, folder: str) -> tuple[int, dict[int, str]]:
    """Number of the last fold of a query (-1: none) and, by number, the finished folders that count: that fold and later batches."""
    found = {"batch": {}, "upto": {}}
    for name in _entries(spark, folder):
        kind, _, number = name.partition("=")
        if kind in found and "_SUCCESS" in _entries(spark, f"{folder}/{name}"):
            found[kind][int(number)] = f"{folder}/{name}"
    last = max(found["upto"], default=-1)
    counted = {n: p for n, p in found["batch"].items() if n > last}
    return last, counted | ({last: found["upto"][last]} if last >= 0 else {})


def fold_months(spark: SparkSession, folder: str, upto: int) -> None:
    """One row per month of all batches up to a number, in place of their folders.

    The folded folder counts from the moment it is finished, and then stands for all it holds: a crash before, a crash between
    that and the removal of the old folders, and a repeated batch change no total.
    """
    last, counted = _parts(spark, folder)
    old = {n: p for n, p in counted.items() if n <= upto}
    if last < upto and old:
        spark.read.schema(_MONTHS).parquet(*old.values()).groupBy("month").agg(
            F.sum("amount").cast("decimal(28,2)").alias("amount"), F.sum("tx_count").alias("tx_count")
        ).coalesce(1).write.mode("overwrite").parquet(f"{folder}/upto={upto}")
        last = upto
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in _entries(spark, folder):
        kind, _, number = name.partition("=")
        if kind == "batch" and int(number) <= last or kind == "upto" and int(number) < last:
            files.delete(path(f"{folder}/{name}"), True)


_MONTHS = "month string, amount decimal(28,2), tx_count bigint"


def read_monthly(spark: SparkSession, rollup: str) -> DataFrame:
    folders = [f"{rollup.rstrip('/')}/{name}" for name in _entries(spark, rollup) if name.startswith("query=")]
    paths = [p for folder in folders for p in _parts(spark, folder)[1].values()]
    months = spark.read.schema(_MONTHS).parquet(*paths) if paths else spark.createDataFrame([], _MONTHS)
    return months.groupBy("month").agg(F.sum("amount").cast("double").alias("total"), F.sum("tx_count").alias("tx_count"))


def _finish(query, timeout: int | None) -> bool:
    if timeout is None:
        query.awaitTermination()
        return True
    done = query.awaitTermination(timeout)
    if not done:
        query.stop()
    return done
