"""Rows of a paged interface (offset and limit) as a Spark source, for batches and streams.

A page is a partition, so pages are fetched by the executors side by side, and each one again if its executor is lost. The
offset of a stream is the number of rows taken, which its checkpoint keeps: a run fetches what was added since the last one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Rows of a page.
LIMIT = 20_000


class Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


def pages(start: int, end: int, limit: int = LIMIT) -> list[Page]:
    """Pages that hold the rows from `start` to before `end`; at least one, as a read has a partition."""
    return [Page(at, min(limit, end - at)) for at in range(start, end, limit)] or [Page(start, 0)]


def paged_source(name: str, schema: T.StructType, total: Callable[[], int],
                 fetch: Callable[[int, int], Iterator[pa.RecordBatch]], limit: int = LIMIT) -> type[DataSource]:
    """A source format of that name.

    total() is the number of rows there are now, fetch(offset, limit) yields the rows of a page as Arrow batches with the columns
    of the schema. Rows must keep their places: new ones come after the old. Both functions run in Python workers.
    """

    def rows(page: Page) -> Iterator[pa.RecordBatch]:
        found = 0
        for batch in fetch(page.offset, page.limit) if page.limit else ():
            found += batch.num_rows
            yield batch
        if found != page.limit:
            raise OSError(f"{found} rows instead of {page.limit} from row {page.offset}")

    class Reader(DataSourceReader):
        def partitions(self):
            return pages(0, total(), limit)

        def read(self, partition):
            return rows(partition)

    class StreamReader(DataSourceStreamReader):
        def initialOffset(self):
            return {"rows": 0}

        def latestOffset(self):
            return {"rows": total()}

        def partitions(self, start, end):
            return pages(start["rows"], end["rows"], limit)

        def read(self, partition):
            return rows(partition)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

        def streamReader(self, schema):
            return StreamReader()

    return Source


def parquet_pages(files: Callable[[], list[str]]) -> tuple[Callable[[], int], Callable[[int, int], Iterator[pa.RecordBatch]]]:
    """total and fetch over Parquet files in the order that `files` lists them; a page opens only the row groups it needs."""

    def total() -> int:
        return sum(pq.read_metadata(f).num_rows for f in files())

    def fetch(offset: int, limit: int) -> Iterator[pa.RecordBatch]:
        at, end = 0, offset + limit
        for name in files():
            file = pq.ParquetFile(name)
            for group in range(file.metadata.num_row_groups):
                n = file.metadata.row_group(group).num_rows
                lo, hi = max(offset, at), min(end, at + n)
                if lo < hi:
                    yield from file.read_row_group(group).slice(lo - at, hi - lo).to_batches()
                at += n

    return total, fetch


def read_pages(spark: SparkSession, source: type[DataSource]) -> DataFrame:
    """All rows there are now."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()


def stream_pages(spark: SparkSession, source: type[DataSource]) -> DataFrame:
    """Rows as they are added."""
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).load()
