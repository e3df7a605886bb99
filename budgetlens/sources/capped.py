"""A data source for raw rows that are read in order up to a cap.

``spark.read.format("ordered_rows")`` reads the Parquet files of a folder by name and gives every row its ordinal ``n``
from 1.  The footers tell how many rows each row group has, so ordinals are known before anything is read; bounds of
``n`` drop all row groups outside them and end the reading of the last one at the cap.  Bounds are options: Spark keeps
what is pushed into a Python reader for later queries over the same table, where it would be wrong.  The scans of construction stop at two caps: a number of rows, and a number of documents that are kept; the second is
looked for in growing prefixes, so what lies far behind it is never read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema as S
from . import construct

#: Rows of the first prefix in which the cap of documents is looked for, and how prefixes grow.
FIRST, GROWTH = 2_000, 4
FORMAT = "ordered_rows"


def _opened(path: str):
    """(file system, path) of a folder's address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(system, path: str) -> list[str]:
    from pyarrow import fs

    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [path]
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))


@dataclass
class Group(InputPartition):
    """A row group: its file, its number in it, the ordinal before its first row, its rows, and the wanted ordinals."""

    file: str
    number: int
    before: int
    rows: int
    low: int
    high: int


class OrderedReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, low: int, high: int) -> None:
        self.path, self.schema, self.low, self.high = path, schema, low, high

    def partitions(self) -> list[Group]:
        import pyarrow.parquet as pq

        system, path = _opened(self.path)
        out, before = [], 0
        for file in _files(system, path):
            if before >= self.high:
                break  # footers behind the cap are not opened
            meta = pq.read_metadata(file, filesystem=system)
            for g in range(meta.num_row_groups):
                rows = meta.row_group(g).num_rows
                if before + rows >= self.low and before < self.high:
                    out.append(Group(file, g, before, rows, self.low, self.high))
                before += rows
        return out or [Group("", 0, 0, 0, 1, 0)]

    def read(self, partition: Group):
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.file:
            return
        system, _ = _opened(self.path)
        kind = to_arrow_schema(self.schema)
        at = partition.before
        columns = [f.name for f in self.schema.fields if f.name != "n"]
        for batch in pq.ParquetFile(partition.file, filesystem=system).iter_batches(1024, row_groups=[partition.number], columns=columns):
            if at >= partition.high:
                return
            n = np.arange(at + 1, at + 1 + len(batch))
            at += len(batch)
            keep = pa.array((n >= partition.low) & (n <= partition.high))
            table = pa.Table.from_batches([batch]).append_column("n", pa.array(n)).select(kind.names).cast(kind).filter(keep)
            yield from table.combine_chunks().to_batches()


class OrderedRows(DataSource):
    """Options: path, a folder of Parquet files or one file; low and high, the first and last ordinal to read.

    The schema has to be given, with ``n bigint`` in it.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: T.StructType) -> OrderedReader:
        return OrderedReader(self.options["path"], schema, int(self.options.get("low", 1)), int(self.options.get("high", 1 << 62)))


def ordered_rows(spark: SparkSession, path: str, schema: T.StructType, low: int = 1, high: int = 1 << 62) -> DataFrame:
    """The rows of a folder with ordinals n from low to high."""
    spark.dataSource.register(OrderedRows)
    return spark.read.format(FORMAT).schema(T.StructType([T.StructField("n", T.LongType()), *schema.fields])).option("low", low).option("high", high).load(path)


def prefix(spark: SparkSession, path: str, schema: T.StructType, kept: Callable[[DataFrame], DataFrame], most_rows: int, most_kept: int, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """The shortest prefix tried of a folder's rows, up to most_rows, of which kept() keeps most_kept rows, or all."""
    upto = min(first, most_rows)
    while upto < most_rows:
        rows = ordered_rows(spark, path, schema, 1, upto)
        if kept(rows).limit(most_kept).count() >= most_kept or not ordered_rows(spark, path, schema, upto + 1, upto + 1).count():
            break
        upto = min(most_rows, upto * growth)
    return ordered_rows(spark, path, schema, 1, upto)


def short_form(spark: SparkSession, path: str, most_rows: int = construct.SHORT_ROWS, most_docs: int = construct.KB_DOCS, first: int = FIRST, **how) -> tuple[DataFrame, DataFrame]:
    """construct.short_form() of a folder's rows, reading no more than a prefix that holds what is kept."""
    kept = lambda part: construct.short_form(part, "n", most_rows=most_rows, most_docs=most_docs, **how)[0]
    return construct.short_form(prefix(spark, path, S.SHORT_FORM_ROW, kept, most_rows, most_docs, first), "n", most_rows=most_rows, most_docs=most_docs, **how)


def multi_hop(spark: SparkSession, path: str, most_rows: int = construct.HOP_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """construct.multi_hop() of a folder's rows; no row behind the cap is read."""
    return construct.multi_hop(ordered_rows(spark, path, S.MULTI_HOP_ROW, 1, most_rows), "n", most_rows)
