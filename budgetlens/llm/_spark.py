"""Session helpers: inputs, scratch tables in the shared folder, worker-wide caches, Arrow batch size."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what an Arrow batch holds; texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, else a folder of the warehouse, which executors share too."""
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def written(df: DataFrame, rows: int = 0) -> DataFrame:
    """df as a Parquet table in the shared folder; it is deleted when the session's JVM ends, or by dropped().

    rows: the most that a file gets, 0 for any number; readers hold thousands of rows of a file at once, however long.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    fs, hadoop = _fs(spark, path)
    fs.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that no later plan reads."""
    for df in tables:
        if df is not None and getattr(df, "_scratch", None):
            fs, hadoop = _fs(df.sparkSession, df._scratch)
            fs.delete(hadoop, True)


def below_hash(df: DataFrame, key: str, n: int, k: int) -> DataFrame:
    """About 1.25 * k of df's n rows, those of the least hashes of their keys."""
    cut = min(2**63 - 1, int(-(2**63) + (1.25 * k + 100) / max(1, n) * 2**64))
    return df.filter(F.xxhash64(key) <= F.lit(cut))


def first_by_hash(df: DataFrame, key: str, n: int, k: int) -> DataFrame:
    """The first k of df's n rows by a hash of their keys, cut before they are sorted: else each task would send k rows to
    the driver.  A few very frequent keys may give fewer than k."""
    return below_hash(df, key, n, k).orderBy(F.xxhash64(key), key).limit(k)


def tidied(run):
    """run, giving back at its end what the worker's allocators keep: idle workers stay alive beside busy ones."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow() of a generator function of batches."""
    return df.mapInArrow(tidied(run), schema)


def worker_cache() -> dict:
    """A dict that lives as long as a Python worker, across tasks."""
    return sys.modules.setdefault("_budgetlens_worker", types.ModuleType("_budgetlens_worker")).__dict__.setdefault("cache", {})


def free(df: DataFrame, *names: str) -> tuple[str, ...]:
    """names, with underscores before them until df has no such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def ascii_lower(c):
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
