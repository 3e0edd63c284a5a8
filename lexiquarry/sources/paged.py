"""Services that hand out their rows by pages, as a Python data source."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator, Sequence
from itertools import count

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[int, int], pa.Table]


class _Pages(InputPartition):
    """Pages first, first + step, ... below end; without an end, up to the service's last."""

    def __init__(self, first: int, step: int, end: int | None) -> None:
        super().__init__(first)
        self.first, self.step, self.end = first, step, end


def paged(spark: SparkSession, name: str, fetch: Fetch, schema: str, size: int = 1000, readers: int = 8, rows: int | None = None, pages_each: int = 100) -> DataFrame:
    """All rows of a service whose ``fetch(offset, limit)`` gives a page of rows; ``name`` is the format's name.

    Where the service tells its number of rows, each reader, a partition of its own, takes ``pages_each`` pages that follow one another;
    the last goes on behind them, should there be more by now. Where it doesn't, each of ``readers`` takes every ``readers``-th page. A reader ends at its
    first short or empty page, and no page is held but the current one; a scan of n pages asks for at most n + the number of readers.
    The service must keep one order of its rows (by a key, or as stored) while it is read. A page for which ``fetch`` raises
    fails its task, which Spark tries again. Columns of a page that the schema doesn't name are dropped.
    """
    if min(size, readers, pages_each) < 1 or (rows or 0) < 0:
        raise ValueError("size, readers and pages_each must be at least 1, and rows at least 0")

    class Reader(DataSourceReader):
        def __init__(self, names: Sequence[str]) -> None:
            self.names = list(names)

        def partitions(self) -> Sequence[InputPartition]:
            if rows is None:
                return [_Pages(i, readers, None) for i in range(readers)]
            starts = range(0, max(1, -(-rows // size)), pages_each)
            return [_Pages(i, 1, None if i == starts[-1] else i + pages_each) for i in starts]

        def read(self, partition: _Pages) -> Iterator[pa.RecordBatch]:
            for page in count(partition.first, partition.step) if partition.end is None else range(partition.first, partition.end, partition.step):
                rows = fetch(page * size, size)
                yield from rows.select(self.names).to_batches()
                if rows.num_rows < size:
                    return

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(schema.names)

    spark.dataSource.register(Source)
    return spark.read.format(name).load()


class ParquetPages:
    """Pages of a Parquet table's rows, in the order of its files' names, from any store that Arrow reads. Holds one row group at a time."""

    def __init__(self, uri: str, columns: Sequence[str]) -> None:
        self.uri, self.columns = uri, list(columns)
        self._groups: list[tuple[str, int]] | None = None

    def __getstate__(self) -> dict:
        return {"uri": self.uri, "columns": self.columns, "_groups": None}

    def _open(self) -> None:
        self._store, path = fs.FileSystem.from_uri(self.uri)
        found = self._store.get_file_info(path)
        files = [path] if found.is_file else sorted(f.path for f in self._store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.base_name.endswith(".parquet") and f.base_name[0] not in "._")
        self._groups, self._starts, self._held = [], [0], (None, None)
        for f in files:
            with self._store.open_input_file(f) as handle:
                footer = pq.read_metadata(handle)
            for g in range(footer.num_row_groups):
                self._groups.append((f, g))
                self._starts.append(self._starts[-1] + footer.row_group(g).num_rows)

    def rows(self) -> int:
        """The number of rows, from the files' footers."""
        if self._groups is None:
            self._open()
        return self._starts[-1]

    def _group(self, i: int) -> pa.Table:
        if self._held[0] != i:
            path, g = self._groups[i]
            with self._store.open_input_file(path) as handle:
                self._held = (i, pq.ParquetFile(handle).read_row_group(g, self.columns))
        return self._held[1]

    def __call__(self, offset: int, limit: int) -> pa.Table:
        parts, end = [], min(offset + limit, self.rows())
        while offset < end:
            i = bisect.bisect_right(self._starts, offset) - 1
            stop = min(end, self._starts[i + 1])
            parts.append(self._group(i).slice(offset - self._starts[i], stop - offset))
            offset = stop
        return pa.concat_tables(parts) if parts else pa.table({c: [] for c in self.columns})
