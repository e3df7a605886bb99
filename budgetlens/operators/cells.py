"""Exact dense search that skips cells of vectors.

Vectors are grouped around centroids, which k-means finds in a bounded sample; every vector goes to its nearest one.  A
cell knows its number of vectors, its radius, and the least and largest value of each component, so no score in it can
exceed query . centroid + |query| * radius, nor the sum of what each component can give.  A query first meets the most
promising cells that hold k vectors; the k-th score found there rules out the cells whose bound is under it.  Vectors
lie sorted by cell, so cells that no query needs are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import files
from . import dense

#: Most cells, vectors of a cell on average, vectors that centroids are sought in, rounds of k-means.
CELLS, CELL_ROWS, SAMPLE, ROUNDS = 1024, 64, 8192, 6
#: Queries whose bounds are computed together, a number for each cell.
TILE_QUERIES = 512
#: What rounding may add to a score, with the unit of its order.
MARGIN = 4e-9


@dataclass
class CellIndex:
    """vectors(doc_id, vec, norm, cell), and for each cell its centroid, radius, bounds of components and size."""

    vectors: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sizes: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest score that each query can have in each cell."""
        ball = queries @ self.centroids.T + np.linalg.norm(queries, axis=1)[:, None] * self.radius
        box = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        return np.where(self.sizes > 0, np.minimum(ball, box), -np.inf)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)


def centroids(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from n rows of x; cells that lose all rows keep their centroid."""
    out = x[np.linspace(0, len(x) - 1, n).astype(np.int64)].copy()
    for _ in range(rounds):
        own = _nearest(x, out)
        order = np.argsort(own, kind="stable")
        kinds, first = np.unique(own[order], return_index=True)
        out[kinds] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return out


def _assigned(points: np.ndarray):
    def run(batches):
        for batch in batches:
            x = dense._matrix(batch.column(1))
            cell = _nearest(x / batch.column(2).to_numpy(zero_copy_only=False)[:, None], points) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    return run


def _described(points: np.ndarray):
    """(cell, n, radius, low, high) of a task's vectors."""

    def run(batches):
        n, radius = np.zeros(len(points), np.int64), np.zeros(len(points))
        low, high = np.full(points.shape, np.inf), np.full(points.shape, -np.inf)
        for batch in batches:
            if not len(batch):
                continue
            x = dense._matrix(batch.column(1)) / batch.column(2).to_numpy(zero_copy_only=False)[:, None]
            cell = batch.column(3).to_numpy(zero_copy_only=False)
            np.add.at(n, cell, 1)
            np.maximum.at(radius, cell, np.linalg.norm(x - points[cell], axis=1))
            np.minimum.at(low, cell, x)
            np.maximum.at(high, cell, x)
        at = np.flatnonzero(n)
        arrays = [pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(radius[at]), pa.array(low[at].tolist(), pa.list_(pa.float64())), pa.array(high[at].tolist(), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["cell", "n", "radius", "low", "high"])

    return run


def _merged(key, table):
    """One row of a cell's rows, of which each task has one."""
    both = [np.array(table[c].to_pylist()) for c in ("low", "high")]
    arrays = [[key[0].as_py()], [sum(table["n"].to_pylist())], [max(table["radius"].to_pylist())], [both[0].min(0).tolist()], [both[1].max(0).tolist()]]
    return pa.table([pa.array(a, k) for a, k in zip(arrays, (pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], table.column_names)


def _first_by_hash(docs: DataFrame, n: int, k: int) -> DataFrame:
    """The first k of n documents by a hash of their ids, of rows that are cut before each task sends its first k."""
    h = F.xxhash64("doc_id")
    cut = min(2**63 - 1, int(-(2**63) + (1.25 * k + 100) / max(1, n) * 2**64))
    return docs.filter(h <= F.lit(cut)).orderBy(h, "doc_id").limit(k)


def build(docs: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> CellIndex:
    """The index of docs(doc_id, vec[, norm]); vectors without a positive norm are left out.

    sample: vectors, by a hash of their ids, that centroids are sought in; all vectors are indexed.
    """
    norm = F.col("norm").cast("double") if "norm" in docs.columns else F.lit(1.0)
    slim = docs.filter(F.col("vec").isNotNull()).select("doc_id", F.col("vec").cast("array<double>").alias("vec"), norm.alias("norm")).filter("norm > 0")
    total = slim.count()
    few = [np.array(r["vec"]) / r["norm"] for r in _first_by_hash(slim, total, sample).collect()]
    points = np.array(few) if few else np.zeros((1, 1))
    n = cells or min(CELLS, max(1, total // CELL_ROWS))
    points = centroids(points, min(n, len(points)))
    told = slim.mapInArrow(_assigned(points), "doc_id bigint, vec array<double>, norm double, cell int")
    vectors = files.kept(told.repartitionByRange("cell", F.xxhash64("doc_id")).sortWithinPartitions("cell"))
    kind = "cell int, n bigint, radius double, low array<double>, high array<double>"
    rows = vectors.mapInArrow(_described(points), kind).groupBy("cell").applyInArrow(_merged, kind).collect()  # a row for each cell
    sizes, radius = np.zeros(len(points), np.int64), np.zeros(len(points))
    low, high = np.zeros(points.shape), np.zeros(points.shape)
    for r in rows:
        sizes[r["cell"]], radius[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["radius"], r["low"], r["high"]
    return CellIndex(vectors, points, radius, low, high, sizes)


def pruned_topk(queries: DataFrame, index: CellIndex, k: int, positive: bool = False) -> tuple[DataFrame, DataFrame]:
    """What dense.dense_topk() finds, and (qid, n_all, n_scored): how many vectors there are and how many were scored."""
    spark = index.vectors.sparkSession
    kind, found, counts = "qid string, doc_id bigint, score double", None, []
    for qids, vectors in dense.query_blocks(queries, k):
        shape = (len(qids), len(index.sizes))
        tiles = [slice(i, i + TILE_QUERIES) for i in range(0, len(qids), TILE_QUERIES)]
        need, more = np.zeros(shape, bool), np.zeros(shape, bool)
        for t in tiles:
            order = np.argsort(-index.bounds(vectors[t]), axis=1, kind="stable")
            before = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]
            np.put_along_axis(need[t], order, before < k, axis=1)

        def part(need, qids=qids, vectors=vectors):
            rows = index.vectors.filter(F.col("cell").isin(np.flatnonzero(need.any(0)).tolist()))
            return dense.few_tasks(rows).mapInArrow(dense._search(qids, vectors, k, positive, need), kind)

        first = files.kept(dense.ranked(part(need), k, F.desc(X.scaled(F.col("score"))), "doc_id").drop("rank"))
        # the k-th score of each query of this block
        last = {r["qid"]: r["last"] for r in first.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("last")).collect() if r["last"] is not None}
        floor = np.array([last.get(q, -np.inf) for q in qids])
        for t in tiles:
            bound = index.bounds(vectors[t])
            more[t] = ~need[t] & (bound + MARGIN * np.maximum(1.0, np.abs(bound)) >= floor[t, None]) & ((bound > 0) | (not positive)) & (index.sizes > 0)
            counts += [(q, int(index.sizes.sum()), int(n)) for q, n in zip(qids[t], (need[t] | more[t]) @ index.sizes)]
        both = first.union(part(more))
        found = both if found is None else found.union(both)
    reads = spark.createDataFrame(counts, "qid string, n_all bigint, n_scored bigint")
    if found is None:
        return spark.createDataFrame([], f"{kind}, rank int").select("qid", "doc_id", "rank", "score"), reads
    return dense.ranked(found, k, F.desc(X.scaled(F.col("score"))), "doc_id").select("qid", "doc_id", "rank", "score"), reads
