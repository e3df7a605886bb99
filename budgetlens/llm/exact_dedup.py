"""Exact deduplication by content-defined chunk recipes.

A gear hash over the last 32 bytes cuts each text where its content says so, whatever stands before.  Chunks get keyed
128-bit identifiers.  The distinct (identifier, chunk) pairs of the corpus meet once, after each task has combined its
own copies, to verify that no identifier stands for two contents; if one does, all is done again with another key.
From then on a document is the ordered list of its chunks' identifiers, and two texts are equal exactly when these
lists are: long documents never move again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark, _text

ID_BYTES = 16
#: Members of a group whose result is sent to all tasks, and the most of such groups; more are joined by a shuffle.
HOT, HOT_GROUPS = 1000, 20_000


def _gear() -> np.ndarray:
    return (_text.mix(np.arange(1, 257, dtype=np.uint64) * _text._ODD) >> np.uint64(32)).astype(np.uint32)


def cuts(buf: np.ndarray, off: np.ndarray, bits: int, least: int, most: int):
    """For each text in turn the ends of its chunks, as positions in buf.  least must be at least 32."""
    h = _gear()[buf]
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s] << np.uint32(s)
    marks = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    at = np.searchsorted(marks, off)
    for i in range(len(off) - 1):
        last, end = int(off[i]), int(off[i + 1])
        ends = []
        for m in marks[at[i] : at[i + 1]].tolist() + [end]:
            while m - last > most:
                last += most
                ends.append(last)
            if m - last >= least or m == end > last:
                ends.append(m)
                last = m
        yield ends


def chunk_id(body: bytes, key: int) -> bytes:
    return hashlib.blake2b(body, digest_size=ID_BYTES, key=key.to_bytes(4, "little")).digest()


def _chunks(batch: pa.RecordBatch, params: tuple[int, int, int]):
    """(lower-cased text, chunk bodies) of each text."""
    buf, off = _text.strings(batch.column(1))
    for a, b in _text.slices(off):
        low = _text.lower(buf[off[a] : off[b]])
        at = off[a : b + 1] - off[a]
        raw = low.tobytes()
        for i, ends in enumerate(cuts(low, at, *params)):
            start, bodies = int(at[i]), []
            for e in ends:
                bodies.append(raw[start:e])
                start = e
            yield raw[at[i] : at[i + 1]], bodies


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 10, least: int = 256, most: int = 8192, tries: int = 8, identify=chunk_id) -> DataFrame:
    """A row for each row of df: key, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one, and all empty texts are equal.
    Of equal texts the largest key stays.  Rows that repeat a key with an equal text are all counted, and all kept if
    that key is the largest.  Null keys lose to any other; a group of null keys only has keep_id and kept null.  No
    rows give no rows; other columns are not looked at.
    bits: a chunk ends at about every 2**bits-th byte, within least and most.
    """
    spark = df.sparkSession
    _spark.small_batches(spark)
    slim = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    params = (bits, least, most)

    def parts(seed):
        def run(batches):
            for batch in batches:
                seen = {}
                for _, bodies in _chunks(batch, params):
                    for body in bodies:
                        seen.setdefault((identify(body, seed), body))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.binary()), pa.array([b for _, b in seen], pa.binary())], ["id", "body"])

        return run

    def recipes(seed):
        def run(batches):
            for batch in batches:
                hashes, lists = [], []
                for raw, bodies in _chunks(batch, params):
                    hashes.append(hashlib.sha256(raw).hexdigest())
                    lists.append(b"".join(identify(body, seed) for body in bodies))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.string()), pa.array(lists, pa.binary())], ["doc_id", "text_sha256", "recipe"])

        return run

    for seed in range(tries):
        chunks = _spark.mapped(slim, parts(seed), "id binary, body binary").distinct()
        if not chunks.groupBy("id").count().filter("count > 1").limit(1).count():
            break
    else:
        raise RuntimeError(f"chunk identifiers clash under {tries} keys")
    kind = slim.schema["doc_id"].dataType.simpleString()
    rows = _spark.written(_spark.mapped(slim, recipes(seed), f"doc_id {kind}, text_sha256 string, recipe binary"))
    groups = _spark.written(rows.groupBy(F.col("recipe").alias("_r")).agg(F.max("doc_id").alias("_keep"), F.count("*").alias("_n")).filter("_n > 1"))
    met = F.col("recipe") == F.col("_r")
    # members of a large group stay where they are
    hot = F.broadcast(groups.filter(F.col("_n") > HOT))
    some = groups.filter(F.col("_n") > HOT).count()
    if 0 < some <= HOT_GROUPS:
        out = rows.join(hot, met).union(rows.join(hot, met, "left_anti").join(groups.filter(F.col("_n") <= HOT), met, "left"))
    else:
        out = rows.join(groups, met, "left")
    keep = F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return out.select(F.col("doc_id").alias(key), keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("bigint").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def op7_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_spark.table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
