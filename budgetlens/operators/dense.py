"""Exact dense search.

A stated set of queries meets all documents in blocks: each task multiplies its batches with a block of queries and
keeps its best k for each, so what is shuffled is partitions x queries x k rows, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Numbers in a block of queries that is sent to the tasks, and entries of the lists that a task keeps for a block.
BLOCK_FLOATS, BLOCK_ENTRIES = 4 << 20, 4 << 20


def ranked(df: DataFrame, k: int, *order) -> DataFrame:
    """df with rank (from 1) within qid by order, up to k."""
    w = Window.partitionBy("qid").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def few_tasks(df: DataFrame) -> DataFrame:
    """df in one task for each core at most.  Each task keeps a list for every query, so what is shuffled then grows with
    the queries, however many files or partitions the documents have."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from left to right."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


#: Documents that are scored together, and scores of such a tile.
ROWS, TILE = 8192, 2 << 20


def _gathered(batches):
    """Batches of ROWS rows or a few more, whatever the session's batch size is."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(ROWS)
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(ROWS)


def _parts(batch: pa.RecordBatch, need: np.ndarray | None, n: int):
    """(rows, queries) that are to meet, in tiles: all, or those whose query needs the rows' cell."""
    each = max(1, TILE // max(1, batch.num_rows))
    if need is None:
        for i in range(0, n, each):
            yield batch, np.arange(i, min(n, i + each))
        return
    cell = batch.column(3).to_numpy(zero_copy_only=False)
    for c in np.unique(cell):
        asked = np.flatnonzero(need[:, c])
        if len(asked):
            rows = batch.take(pa.array(np.flatnonzero(cell == c)))
            for i in range(0, len(asked), each):
                yield rows, asked[i : i + each]


def _search(qids: list, queries: np.ndarray, k: int, positive: bool, need: np.ndarray | None = None):
    """The best k of each query among a task's (doc_id, vec, norm[, cell]); need[query, cell] where there are cells."""

    def run(batches):
        kind, best = None, [(np.zeros(0), np.zeros(0, np.int64))] * len(qids)
        floor = np.full(len(qids), -np.inf)  # a document must come near the k-th score so far
        last = docs = None
        for batch, asked in ((b, q) for some in _gathered(batches) for b, q in _parts(some, need, len(qids))):
            kind = batch.schema.field(0).type
            if batch is not last:
                last, docs = batch, _matrix(batch.column(1))
                ids, norm = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            if not len(docs):
                continue
            near = queries[asked] @ docs.T / norm
            # what rounding may cost is left
            held = floor[asked]
            able = np.nanmax(near, axis=1) >= held - 4e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(held), held, 0.0)))
            for row, q in zip(near[able], asked[able]):
                edge = floor[q]
                # less what rounding may have cost
                at = np.flatnonzero(row >= edge - 4e-9 * max(1.0, abs(edge))) if np.isfinite(edge) else np.arange(len(row))
                if len(at) > k:
                    edge = np.partition(row[at], len(at) - k)[len(at) - k]
                    at = at[row[at] >= edge - 4e-9 * max(1.0, abs(edge))] if np.isfinite(edge) else at
                score = _exact(docs[at], queries[q]) / norm[at]
                own = np.isfinite(score) & ((score > 0) | (not positive))
                score = np.concatenate([best[q][0], score[own]])
                mine = np.concatenate([best[q][1], ids[at[own]]])
                keep = np.lexsort((mine, -np.floor(score * 1e9 + 0.5)))[:k]
                best[q] = score[keep], mine[keep]
                if len(keep) == k:
                    floor[q] = score[keep].min()
        if kind is not None:
            lengths = [len(s) for s, _ in best]
            columns = [pa.array(np.repeat(np.array(qids, dtype=object), lengths), pa.string()), pa.array(np.concatenate([i for _, i in best]), kind), pa.array(np.concatenate([s for s, _ in best]))]
            yield pa.RecordBatch.from_arrays(columns, ["qid", "doc_id", "score"])

    return run


def query_blocks(queries: DataFrame, k: int = 1) -> Iterator[tuple[list, np.ndarray]]:
    """Blocks of (qids, vectors) of queries(qid, vec), bounded in size, also of lists of k for each."""
    qids, rows = [], []
    for r in queries.select(F.col("qid").cast("string"), F.col("vec").cast("array<double>")).toLocalIterator():
        if r["vec"]:
            qids.append(r["qid"])
            rows.append(r["vec"])
        if rows and (len(rows) * len(rows[0]) >= BLOCK_FLOATS or len(rows) * k >= BLOCK_ENTRIES):
            yield qids, np.array(rows)
            qids, rows = [], []
    if rows:
        yield qids, np.array(rows)


def dense_topk(queries: DataFrame, docs: DataFrame, k: int, positive: bool = False) -> DataFrame:
    """(qid, doc_id, rank, score): the k documents of largest inner product for each query; equal ones by doc_id.

    queries(qid, vec), docs(doc_id bigint, vec[, norm]): where docs has a norm, scores are divided by it; a null or
    zero norm drops the document, as does a null vector.  positive: only scores over 0.  Scores are ordered as whole
    billionths.
    """
    norm = F.col("norm").cast("double") if "norm" in docs.columns else F.lit(1.0)
    slim = docs.filter(F.col("vec").isNotNull()).select("doc_id", F.col("vec").cast("array<double>").alias("vec"), norm.alias("norm")).filter("norm > 0")
    found = None
    for qids, vectors in query_blocks(queries, k):
        part = few_tasks(slim).mapInArrow(_search(qids, vectors, k, positive), "qid string, doc_id bigint, score double")
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "qid string, doc_id bigint, rank int, score double")
    return ranked(found, k, F.desc(X.scaled(F.col("score"))), "doc_id").select("qid", "doc_id", "rank", "score")


#: Texts to vectors of one length.
Embedder = Callable[[pd.Series], list[list[float]]]


def embedded(df: DataFrame, text: str, embed: Callable[[], Embedder], name: str = "vec") -> DataFrame:
    """df with the vector of its text.  embed() makes the model, once for each task."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embed()
        for texts in batches:
            yield pd.Series(model(texts.fillna("")))

    return df.withColumn(name, vectors(F.col(text)))


def hashing_vectors(df: DataFrame, key: str, text: str, cells: int = 256) -> DataFrame:
    """(key, vec, norm): counts of a text's tokens in hashed cells; norm is null for texts without tokens.

    The deterministic stand-in for a neural embedder, built from the tokens in the JVM.
    """
    terms = df.select(key, F.explode(X.tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    return hashed(terms, key, cells)


def hashed(terms: DataFrame, key: str = "doc_id", cells: int = 256) -> DataFrame:
    """hashing_vectors() of counted terms(key, term, tf), such as an index's postings."""
    sums = terms.groupBy(key, (X.hash16(F.col("term")) % cells).cast("int").alias("cell")).agg(F.sum("tf").cast("double").alias("w"))
    lists = sums.groupBy(key).agg(F.collect_list(F.struct("cell", "w")).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    kind = terms.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            off, flat = lists.offsets.to_numpy(), lists.values
            out = np.zeros((len(lists), cells))
            out[np.repeat(np.arange(len(lists)), np.diff(off)), flat.field(0).to_numpy()[off[0] : off[-1]]] = flat.field(1).to_numpy()[off[0] : off[-1]]
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, cells), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors, batch.column(2)], [key, "vec", "norm"])

    return lists.select(key, "m", "norm").mapInArrow(run, f"`{key}` {kind}, vec array<double>, norm double")


def hashed_lists(lists: DataFrame, cells: int = 256) -> DataFrame:
    """hashed() of lexical.listed(): each document's vector is made in its own row."""
    cell = F.transform(F.split("words", " "), lambda t: (X.hash16(t) % cells).cast("int"))
    rows = lists.filter("words <> ''").select("doc_id", cell.alias("cell"), F.split("tfs", " ").cast("array<double>").alias("w"))
    kind = lists.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in (x.slice(i, 1024) for x in batches for i in range(0, x.num_rows, 1024)):
            of = np.diff(batch.column(1).offsets.to_numpy())
            at = np.repeat(np.arange(len(of)), of) * cells + batch.column(1).flatten().to_numpy()
            out = np.bincount(at, batch.column(2).flatten().to_numpy(), len(of) * cells)
            norm = np.sqrt((out.reshape(-1, cells) ** 2).sum(1))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, cells), pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors, pa.array(norm)], ["doc_id", "vec", "norm"])

    return rows.mapInArrow(run, f"doc_id {kind}, vec array<double>, norm double")
