"""Hard negatives by vantage-point trees over norm-augmented vectors.

One more component, sqrt(M^2 - |x|^2) for the largest norm M, puts all rows on one sphere, and an anchor q gets a zero
there: then distance^2 = |q|^2 + M^2 - 2 * score, so rows come nearest first as their scores fall, and a window of scores
is an annulus of distances.

A tree of vantage points, fitted to a bounded sample, splits the rows into cells by distance; every row goes to the cell
that its distances name.  A cell's rows, dealt to as many blocks as their number asks for, get a vantage-point tree each.
An anchor visits its nearest cell first and then only those that can still hold something better.  In a block each anchor
of a chunk visits its nearest leaves first, in the order of its own lower bounds, and then those that its k rows and its
annulus leave.  Components, scores and comparisons of scores are whole numbers; distances only decide what can be skipped,
with a margin for rounding.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _spark

#: Rows of a block, anchors of a chunk, rows of a leaf.
BLOCK, CHUNK, LEAF = 8192, 1024, 128
#: Blocks and chunks of a file.
FILE_BLOCKS, FILE_CHUNKS = 8, 64
#: Leaves of a block that each anchor visits in its own order.
FIRST = 4
#: Rows that the tree of cells is fitted to, and how many of them each cell has at least.
SAMPLE, SAMPLE_CELL = 16_384, 64
#: Share of M by which rounding may put a bound off.
MARGIN = 4e-6
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
FAR = np.int64(2**62)
_UNIT = "anchor bigint, unit bigint, label bigint, low bigint, high bigint, x binary"
_FOUND = "anchor bigint, unit bigint, vec_id bigint, score bigint"


def quantised(vec: Column, scale: int = 256) -> Column:
    """Whole components floor(scale * x); null where a vector or a component is null or not finite."""
    wide = F.transform(vec, lambda x: x.cast("double"))
    # NaN is greater than infinity in Spark's order
    fine = F.forall(wide, lambda x: x.isNotNull() & (x < math.inf) & (x > -math.inf))
    return F.when(vec.isNotNull() & fine, F.transform(wide, lambda x: F.floor(x * scale).cast("bigint")))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of a binary column of 64-bit numbers; missing components are 0."""
    rows = [np.frombuffer(b, np.int64) for b in column.to_pylist()]
    out = np.zeros((len(rows), dim), np.int64)
    for r, x in zip(out, rows):
        r[: len(x)] = x
    return out


def _kind(a: np.ndarray, b: np.ndarray) -> tuple[type, int]:
    """The quickest type in which a @ b.T is exact, and what no score exceeds."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most >= 2**55:
        raise ValueError("scores do not fit in 55 bits")
    return (np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64), most


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers."""
    kind, _ = _kind(a, b)
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _distances(x: np.ndarray, up: np.ndarray, point: np.ndarray, point_up: float, top: float) -> np.ndarray:
    """Distances of rows with augmented components ``up`` to a vantage point."""
    dot = x.astype(np.float64) @ point.astype(np.float64) + up * point_up
    return np.sqrt(np.maximum(0.0, 2 * top - 2 * dot))


def _augmented(x: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, top - (x.astype(np.float64) ** 2).sum(1)))


class Tree:
    """A vantage-point tree: points, and for each leaf the intervals of distances to the points above it.

    order: rows by leaf; leaf i has order[starts[i]:starts[i + 1]].  path[i]: (point, low, high) of each level.
    """

    def __init__(self, x: np.ndarray, top: float, leaf: int, depth: int | None = None) -> None:
        up = _augmented(x, top)
        self.points: list[int] = []
        self.path: list[list[tuple[int, float, float]]] = []
        self.splits: list[tuple[int, float, int, int]] = []  # point, radius, child within, child beyond; leaves are -1 - i
        rows: list[np.ndarray] = []

        def grow(at: np.ndarray, above: list[tuple[int, float, float]], level: int) -> int:
            if len(at) <= leaf or level == depth:
                rows.append(at)
                self.path.append(above)
                return -len(rows)
            # the row that is farthest from the middle sees the others apart; equal rows are halved as they come
            point = int(at[np.argmax(((x[at] - x[at].mean(0)) ** 2).sum(1))])
            d = _distances(x[at], up[at], x[point], float(up[point]), top)
            order = np.argsort(d, kind="stable")
            half = len(at) // 2
            far = float(d[order[half]])
            self.points.append(point)
            p, near, rest = len(self.points) - 1, order[:half], order[half:]
            me = len(self.splits)
            self.splits.append((p, far, 0, 0))
            within = grow(at[near], [*above, (p, float(d[order[0]]), float(d[near].max()))], level + 1)
            beyond = grow(at[rest], [*above, (p, far, float(d[order[-1]]))], level + 1)
            self.splits[me] = (p, far, within, beyond)
            return me

        self.root = grow(np.arange(len(x)), [], 0)
        self.order = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.starts = np.cumsum([0, *map(len, rows)])
        self.at, self.up = x[self.points].copy(), up[self.points].copy()

    def stored(self) -> bytes:
        return pickle.dumps(self.__dict__)

    @classmethod
    def read(cls, raw: bytes) -> Tree:
        tree = object.__new__(cls)
        tree.__dict__.update(pickle.loads(raw))
        return tree

    def bounds(self, q: np.ndarray, top: float, open_ends: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of each anchor of q to what each leaf holds, with the margin.

        open_ends: leaves hold rows that the tree was not built from, so only the radii that split them bound them.
        """
        low, high = np.zeros((len(q), len(self.path))), np.full((len(q), len(self.path)), np.inf)
        dot = q.astype(np.float64) @ self.at.astype(np.float64).T
        d = np.sqrt(np.maximum(0.0, (q.astype(np.float64) ** 2).sum(1)[:, None] + top - 2 * dot))
        for i, path in enumerate(self.path):
            for p, a, b in path:
                if open_ends:
                    radius = self.splits[p][1]
                    a, b = (0.0, radius) if a < radius else (radius, np.inf)
                low[:, i] = np.maximum(low[:, i], np.maximum(d[:, p] - b, a - d[:, p]))
                high[:, i] = np.minimum(high[:, i], d[:, p] + b)
        slack = MARGIN * math.sqrt(top)
        return low - slack, high + slack

    def cells(self, x: np.ndarray, top: float) -> np.ndarray:
        """The leaf of each row, by its distances to the points."""
        up, out = _augmented(x, top), np.zeros(len(x), np.int64)
        held = [(self.root, np.arange(len(x)))]
        while held:
            node, at = held.pop()
            if node < 0:
                out[at] = -1 - node
                continue
            p, radius, within, beyond = self.splits[node]
            near = _distances(x[at], up[at], self.at[p], float(self.up[p]), top) < radius
            held += [(within, at[near]), (beyond, at[~near])]
        return out


def _distance(norm: np.ndarray, top: float, score: np.ndarray) -> np.ndarray:
    """The distance that a score means."""
    return np.sqrt(np.maximum(0.0, norm + top - 2.0 * score.astype(np.float64)))


def _kept(unit: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each unit, by falling score and rising id."""
    order = np.lexsort((ids, -score, unit))
    first = np.flatnonzero(np.append(True, unit[order][1:] != unit[order][:-1])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, who: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool, top: float):
    """(unit, id, score): the k best rows of a block for each unit, an anchor who[i] with its window of scores.

    Rows have the anchor's label (same) or another one, and another id.  Units go through their FIRST nearest leaves each
    in its own order; each other leaf then meets all units at once for which it can still hold something better.
    """
    norm = (q.astype(np.float64) ** 2).sum(1)
    near, far = tree.bounds(q, top)
    # leaves wholly inside the annulus's hole or outside it are never visited
    near = np.where((far < _distance(norm, top, high)[:, None]) | (near > _distance(norm, top, low)[:, None]) | (low > high)[:, None], np.inf, near)
    kind, most = _kind(q, x)
    asked, rows, ids, labels = q.astype(kind), x[tree.order].astype(kind), ids[tree.order], labels[tree.order]
    edges = lambda score: np.clip(score, -most - 1, most + 1).astype(kind)[:, None]
    floor, reach = low.copy(), _distance(norm, top, low)  # a row must reach this score, so lie within this distance
    least, greatest = edges(floor), edges(high)
    held, met = [np.zeros(0, np.int64)] * 3, []

    def meet(own: np.ndarray, leaf: int) -> None:
        begin, end = tree.starts[leaf], tree.starts[leaf + 1]
        s = asked[own] @ rows[begin:end].T
        at = np.flatnonzero((s >= least[own]) & (s <= greatest[own]))
        r, c = own[at // (end - begin)], begin + at % (end - begin)
        fits = ((labels[c] == label[r]) == same) & (ids[c] != who[r])
        met.append([r[fits], ids[c[fits]], s.ravel()[at[fits]].astype(np.int64)])

    def merge() -> None:
        nonlocal held, floor, reach, least
        held = [np.concatenate(c) for c in zip(held, *met)]
        met.clear()
        best = _kept(held[0], held[2], held[1], k)
        held = [c[best] for c in held]
        # units that have k rows must find something as good as their last
        n = np.bincount(held[0], minlength=len(q))
        last = np.full(len(q), FAR)
        np.minimum.at(last, held[0], held[2])
        floor = np.where(n >= k, np.maximum(low, last), low)
        reach, least = _distance(norm, top, floor), edges(floor)

    turn = np.argsort(near, axis=1, kind="stable")[:, :FIRST]
    active = np.arange(len(q))
    for step in range(turn.shape[1]):
        # no leaf behind this one is nearer
        active = active[near[active, turn[active, step]] <= reach[active]]
        leaf = turn[active, step]
        for i in np.unique(leaf):
            meet(active[leaf == i], i)
        near[active, leaf] = np.inf
        merge()
    left = np.isfinite(near)
    for i in np.argsort(np.where(left, near, 0.0).sum(0) / np.maximum(1, left.sum(0)), kind="stable"):
        own = np.flatnonzero(near[:, i] <= reach)
        if len(own):
            meet(own, i)
            if sum(len(m[0]) for m in met) >= len(q):
                merge()
    merge()
    return held


class Index:
    """Blocks of rows with their trees, in a written table, and the tree of cells that routes anchors to them."""

    def __init__(self, rows: DataFrame, blocks: DataFrame, cells: Tree, shares: dict[int, int], top: float, dim: int) -> None:
        self.rows, self.blocks, self.cells, self.shares, self.top, self.dim = rows, blocks, cells, shares, top, dim

    def nearest(self, units: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, unit, vec_id, score): the first k rows for each of units(anchor, unit, label, low, high, x)."""
        first = self._visited(_spark.mapped(units, self._routed(True), f"cell bigint, {_UNIT}"), k, same)
        if len(self.shares) == 1:
            return first
        # what the nearest cell has is the least that other cells must beat
        least = first.groupBy("anchor", "unit").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        raised = units.join(least, ["anchor", "unit"], "left").select("anchor", "unit", "label", F.greatest("low", F.coalesce("least", "low")).alias("low"), "high", "x")
        rest = self._visited(_spark.mapped(raised, self._routed(False), f"cell bigint, {_UNIT}"), k, same)
        order = Window.partitionBy("anchor", "unit").orderBy(F.desc("score"), "vec_id")
        best = first.union(rest).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")
        out = _spark.written(best)
        _spark.dropped(first, rest)
        return out

    def _routed(self, first: bool):
        """Units with the nearest cell that can hold something for them, or with all others."""
        cells, top, dim = self.cells, self.top, self.dim

        def run(batches):
            for batch in batches:
                q = _matrix(batch.column(5), dim)
                low, high = (batch.column(i).to_numpy().astype(np.int64) for i in (3, 4))
                norm = (q.astype(np.float64) ** 2).sum(1)
                near, far = cells.bounds(q, top, open_ends=True)
                hole = far < _distance(norm, top, high)[:, None]
                home = np.argmin(np.where(hole, np.inf, near), axis=1)
                if first:
                    row, cell = np.flatnonzero(low <= high), home[low <= high]
                else:
                    fits = ~hole & (near <= _distance(norm, top, low)[:, None])
                    fits[np.arange(len(q)), home] = False
                    row, cell = np.nonzero(fits & (low <= high)[:, None])
                part = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *part.columns], ["cell", *part.schema.names])

        return run

    def _visited(self, routed: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best of each unit, over the blocks of the cells that it was routed to."""
        routed = _spark.written(routed)
        counts = {r["cell"]: r["count"] for r in routed.groupBy("cell").count().collect()}  # a row for each cell
        chunks = _of(counts, lambda n: -(-n // CHUNK), F.col("cell"))
        dealt = routed.withColumn("chunk", F.pmod(F.xxhash64("anchor"), chunks))
        packed = _spark.written(dealt.groupBy("cell", "chunk").applyInArrow(_packed, "cell bigint, anchors binary, units binary, labels binary, lows binary, highs binary, places binary, xs binary"), FILE_CHUNKS)
        _spark.dropped(routed)
        shares = _of(self.shares, lambda n: n, F.col("cell"))
        asked = packed.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1)))
        top, dim = self.top, self.dim

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    x = np.frombuffer(r["rows"], np.int64).reshape(-1, dim)
                    ids, labels, who, unit, label, low, high, place = (np.frombuffer(r[c], np.int64) for c in ("ids", "kinds", "anchors", "units", "labels", "lows", "highs", "places"))
                    q = np.frombuffer(r["xs"], np.int64).reshape(-1, dim)[place]
                    i, vec, score = search(Tree.read(r["tree"]), x, ids, labels, q, who, label, low, high, k, same, top)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (who[i], unit[i], vec, score)], ["anchor", "unit", "vec_id", "score"])

        # the size of either side is guessed too low, and one that then goes to all tasks passes whole through the driver
        met = asked.join(self.blocks.hint("merge"), ["cell", "share"])
        found = _spark.mapped(met, run, _FOUND)
        order = Window.partitionBy("anchor", "unit").orderBy(F.desc("score"), "vec_id")
        spark = routed.sparkSession
        _spark.small_batches(spark, 4)  # a row is a block and a chunk
        out = _spark.written(found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r"))
        _spark.small_batches(spark)
        _spark.dropped(packed)
        return out


def _of(counts: dict[int, int], value, cell: Column) -> Column:
    """A value for each cell, of which there are a bounded number."""
    pairs = [F.lit(x).cast("bigint") for c, n in sorted(counts.items()) for x in (c, value(n))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), cell), F.lit(1).cast("bigint")) if pairs else F.lit(1).cast("bigint")


def _packed(key, table):
    """A chunk of units in one row: places tells the vector of each, as those of an anchor share one."""
    raw = [pa.array([table[c].to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("anchor", "unit", "label", "low", "high")]
    _, first, place = np.unique(table["anchor"].to_numpy(), return_index=True, return_inverse=True)
    vectors = b"".join(table["x"].take(pa.array(first)).to_pylist())
    own = [pa.array([b], pa.binary()) for b in (place.astype(np.int64).tobytes(), vectors)]
    return pa.table([pa.array([key[0].as_py()]), *raw, *own], ["cell", "anchors", "units", "labels", "lows", "highs", "places", "xs"])


def _block(dim: int, top: float):
    def block(key, table):
        raw = [table[c].to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "label")]
        rows = b"".join(table["x"].to_pylist())
        tree = Tree(np.frombuffer(rows, np.int64).reshape(-1, dim), top, LEAF).stored()
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), *[pa.array([b], pa.binary()) for b in (*raw, rows, tree)]], ["cell", "share", "ids", "kinds", "rows", "tree"])

    return block


def index(df: DataFrame, vec: str, key: str = "vec_id", label: str = "label", scale: int = 256, block: int = BLOCK, sample: int = SAMPLE) -> Index | None:
    """The rows of df that have a key, a label and a whole finite vector, as an Index; None without any.

    Of rows that share a key the greatest by label and vector stands for all.  Shorter vectors count as if zeros
    followed.  sample: rows, by a hash of their keys, that the tree of cells is fitted to; all rows are indexed.
    """
    spark = df.sparkSession
    _spark.small_batches(spark)
    slim = df.select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), quantised(F.col(vec), scale).alias("q"))
    whole = slim.filter("vec_id is not null and label is not null and q is not null").groupBy("vec_id").agg(F.max(F.struct("label", "q")).alias("row"))
    norm = F.aggregate("row.q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = _spark.written(whole.select("vec_id", "row.label", "row.q", norm.alias("norm")))
    n, top, dim = rows.agg(F.count("*"), F.max("norm"), F.max(F.size("q"))).first()
    if not n:
        return None
    dim = max(1, dim)

    def placing(batches):
        for batch in batches:
            lists = batch.column(2)
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            x = np.zeros((len(lists), dim), np.int64)
            for i in range(len(lists)):
                x[i, : at[i + 1] - at[i]] = flat[at[i] : at[i + 1]]
            cell = cells.cells(x, top) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "label", "cell", "x"])

    few = _spark.first_by_hash(rows.select("vec_id", "q"), "vec_id", n, sample).select("q").collect()
    seen = np.zeros((len(few), dim), np.int64)
    for r, (q,) in zip(seen, few):
        r[: len(q)] = q
    depth = max(0, min(math.ceil(math.log2(n / block)), int(math.log2(max(1, len(seen) / SAMPLE_CELL)))))
    cells = Tree(seen, top, 1, depth)
    placed = _spark.written(_spark.mapped(rows.select("vec_id", "label", "q"), placing, "vec_id bigint, label bigint, cell bigint, x binary"))
    _spark.dropped(rows)
    shares = {r["cell"]: -(-r["count"] // block) for r in placed.groupBy("cell").count().collect()}  # a row for each cell
    dealt = placed.withColumn("share", F.pmod(F.xxhash64("vec_id"), _of(shares, lambda n: n, F.col("cell"))))
    blocks = _spark.written(dealt.groupBy("cell", "share").applyInArrow(_block(dim, top), "cell bigint, share bigint, ids binary, kinds binary, rows binary, tree binary"), FILE_BLOCKS)
    return Index(placed, blocks, cells, {c: shares.get(c, 1) for c in range(len(cells.path))}, top, dim)


def hard_negatives(df: DataFrame, vec: str, anchors: Column, key: str = "vec_id", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors of df.

    anchors: a condition on ``vec_id`` and ``label`` as they are called here.  A row's score is its inner product with
    the anchor in whole components floor(scale * x); higher scores come first, ties by smaller key.  Positives are the
    first rows of the anchor's label; to each belong the first rows of other labels whose score lies between ``low`` and
    ``high`` hundredths of the positive's, so a negative positive score has none.  Rows without a key, a label or a whole
    finite vector take no part; of rows that share a key one does; other columns are not looked at; no rows give no rows.
    """
    spark = df.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    made = index(df, vec, key, label, scale, block)
    if made is None:
        return spark.createDataFrame([], schema)
    asked = made.rows.filter(anchors).select(F.col("vec_id").alias("anchor"), F.lit(0).cast("bigint").alias("unit"), "label", F.lit(-int(FAR)).alias("low"), F.lit(int(FAR)).alias("high"), "x")
    found = made.nearest(asked, positives, True).select("anchor", F.col("vec_id").alias("positive"), F.col("score").alias("positive_score"))
    # the whole scores between the hundredths
    floor = lambda percent: F.expr(f"(positive_score * ({percent}) - pmod(positive_score * ({percent}), 100)) div 100")
    lows, highs = -floor(-low), floor(high)
    windows = found.join(asked.select("anchor", "label", "x"), "anchor").select("anchor", F.col("positive").alias("unit"), "label", lows.alias("low"), highs.alias("high"), "x")
    nearest = made.nearest(_spark.written(windows), negatives, False)
    rank = F.row_number().over(Window.partitionBy("anchor", "unit").orderBy(F.desc("score"), "vec_id"))
    told = nearest.select("anchor", F.col("unit").alias("positive"), rank.alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = told.join(found, ["anchor", "positive"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", "negative_id", "positive_score", "negative_score")


def op11_vantage_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 50; where 7 divides the id, the label is another one first."""
    rows = _spark.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), "embedding", F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
negatives AS (
  SELECT anchor_id, positive_id, positive_score, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM positives JOIN scored s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
