"""Links and components of similar texts, from groups of candidates.

Near-duplicate operators put distinct texts into candidate nodes (hash buckets, leaves of a tree).  Here each node is
turned into links that are confirmed on whole texts, in a way that is linear in a node's size where its texts are alike:

* small nodes are compared exhaustively by sketch, and each pair that may be similar is verified;
* a large node gets a few pivots, the members of a fixed-size sample that are closest to its common sketch; each
  member that may be similar to a pivot is verified against it;
* members that no pivot joins get pivots of their own, as long as that joins many;
* those that are left outside their node's main component are compared with all others of the node, or in larger nodes
  joined with them by an exact prefix filter over whole sets, in which what many texts share comes last.

Components come from label propagation with pointer jumping over tables in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

#: Largest node that is compared exhaustively.
SMALL = 16
#: Members of a large node among which its pivots are sought, pivots, and how often they are sought.
SAMPLE, PIVOTS, ROUNDS = 256, 3, 4
#: Largest node whose late members are compared with all others, and its texts' bytes.
MIDDLE, NODE_BYTES = 512, 2 << 20
#: Cells in which tokens are counted, by their upper bits: sent to all tasks, eight bytes each.
CELLS = 1 << 20
_SHIFT = np.uint64(64 - 20)
#: Ids that are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows beyond which a key counts as hot.
HOT = 1000

#: Entries that a task of nodes_of() looks through, and that are packed at a time.
TASK_ENTRIES, PACK = 2_000_000, 1 << 17

#: From a batch to the ids and nodes of its rows.
Entries = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]
#: From bytes and offsets of texts to their sets, as values and offsets.
Sets = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass
class Similarity:
    """sets: see Sets; percent: smallest similarity times 100; loose: smallest share of equal sketch bytes."""

    sets: Sets
    percent: int
    loose: float


def _fixed(column: pa.Array) -> np.ndarray:
    """A binary column whose values have one length, as rows of bytes."""
    buf, off = _binary(column)
    n = len(off) - 1
    return buf[off[0] : off[-1]].reshape(n, -1) if n else np.zeros((0, 1), np.uint8)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def _pairs(a, b) -> pa.RecordBatch:
    low, high = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])


def _node_lists(batch: pa.RecordBatch, k: int):
    """(ids, sketch rows) of each node in a batch whose column k lists structs of id and sketch."""
    lists = batch.column(k)
    off = lists.offsets.to_numpy()
    flat = lists.values
    ids, sketch = flat.field(0).to_numpy(zero_copy_only=False), _fixed(flat.field(1))
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield ids[a:b], sketch[a:b]


def _exhaustive(loose: float):
    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            off = lists.offsets.to_numpy()
            flat = lists.values
            ids, sketch = flat.field(0).to_numpy(zero_copy_only=False), _fixed(flat.field(1))
            least = np.ceil(loose * sketch.shape[1] - 1e-9)
            low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            sizes = np.diff(off)
            for n in np.unique(sizes).tolist():
                # nodes of one size are compared together, place by place
                members = off[:-1][sizes == n][:, None] + np.arange(n)
                for i in range(n - 1):
                    for j in range(i + 1, n):
                        x, y = members[:, i], members[:, j]
                        near = ((sketch[x] == sketch[y]).sum(1) >= least) & (ids[x] != ids[y])
                        low.append(ids[x[near]])
                        high.append(ids[y[near]])
            yield _pairs(np.concatenate(low), np.concatenate(high))

    return run


def _pivots(batches):
    for batch in batches:
        nodes, ids_out, sketches = [], [], []
        for node, (ids, sketch) in zip(batch.column(0).to_pylist(), _node_lists(batch, 1)):
            common = np.array([np.bincount(c, minlength=256).argmax() for c in sketch.T], np.uint8)
            best = np.lexsort((ids, -(sketch == common).mean(1)))[:PIVOTS]
            nodes += [node] * len(best)
            ids_out += ids[best].tolist()
            sketches += [sketch[i].tobytes() for i in best]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(ids_out, pa.int64()), pa.array(sketches, pa.binary())], ["node", "pivot", "pivot_sketch"])


def _near_pivot(loose: float):
    """(node, id, pivot) of rows (node, id, sketch, pivot, pivot's sketch) that may be similar."""

    def run(batches):
        for batch in batches:
            near = (_fixed(batch.column(2)) == _fixed(batch.column(4))).mean(1) >= loose
            near &= batch.column(1).to_numpy() != batch.column(3).to_numpy()
            yield batch.select([0, 1, 3]).filter(pa.array(near))

    return run


def _verified(rule: Similarity):
    """(a, b, text of a, text of b) to the pairs that are similar."""

    def run(batches):
        for batch in batches:
            sides = []
            for k in (2, 3):
                # pairs of one text stand together more often than not: its set is made once for each run
                buf, off = _binary(batch.column(k))
                ids = batch.column(k - 2).to_numpy()
                new = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, int)
                run_of = np.cumsum(np.append(True, ids[1:] != ids[:-1])) - 1 if len(ids) else np.zeros(0, int)
                values = []
                parts = np.concatenate([[0], np.cumsum(off[new + 1] - off[new])]) if len(new) else np.zeros(1, np.int64)
                joined = np.concatenate([np.zeros(0, np.uint8), *(buf[off[i] : off[i + 1]] for i in new)])
                for x, y in _text.slices(parts):
                    v, at = rule.sets(joined[parts[x] : parts[y]], parts[x : y + 1] - parts[x])
                    values += [v[at[i] : at[i + 1]] for i in range(y - x)]
                sides.append((values, run_of))
            (va, ra), (vb, rb) = sides
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = va[ra[i]], vb[rb[i]]
                if 100 * min(len(x), len(y)) >= rule.percent * max(len(x), len(y)) > 0:
                    at = np.searchsorted(x, y)
                    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                    good[i] = 100 * both >= rule.percent * (len(x) + len(y) - both)
            mask = pa.array(good)
            yield batch.select([0, 1]).filter(mask)

    return run


def _asked(rule: Similarity):
    """Links of nodes (list of id, component, asks, text): from those that ask, one to each other component."""

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            bounds = lists.offsets.to_numpy()
            flat = lists.values
            ids, comp, asks = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            buf, off = _binary(flat.field(3))
            low, high = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                v, at = rule.sets(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                size = np.diff(at)
                owner = np.repeat(np.arange(b - a), size)
                order = np.argsort(v, kind="stable")
                tokens, owner = v[order], owner[order]
                for q in np.flatnonzero(asks[a:b].astype(bool)).tolist():
                    x = v[at[q] : at[q + 1]]
                    lo, hi = np.searchsorted(tokens, x, "left"), np.searchsorted(tokens, x, "right")
                    runs = hi - lo
                    where = np.repeat(lo - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
                    both = np.bincount(owner[where], minlength=b - a)
                    hit = np.flatnonzero((100 * both >= rule.percent * (size + len(x) - both)) & (comp[a:b] != comp[a + q]))
                    _, one = np.unique(comp[a + hit], return_index=True)
                    low += [int(ids[a + q])] * len(one)
                    high += ids[a + hit[one]].tolist()
            yield _pairs(np.array(low, np.int64), np.array(high, np.int64))

    return run


def _cells(rule: Similarity):
    """(cell, n, asked): members of the sets of rows (id, component, asks, text) in each cell, and those of sets that ask."""

    def run(batches):
        held = np.zeros((2, CELLS), np.int64)
        for batch in batches:
            asks = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            buf, off = _binary(batch.column(3))
            for a, b in _text.slices(off):
                v, at = rule.sets(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                cell = (v >> _SHIFT).astype(np.int64)
                held[0] += np.bincount(cell, minlength=CELLS)
                held[1] += np.bincount(cell[np.repeat(asks[a:b], np.diff(at))], minlength=CELLS)
        at = np.flatnonzero(held[0])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (at, *held[:, at])], ["cell", "n", "asked"])

    return run


def _fronts(rule: Similarity, sent):
    """(id, component, asks, n, token, after) of rows (id, component, asks, text): the tokens of the first part of each
    text's set of n, as far as texts that ask may have them, and how many such tokens lie from each on."""

    def run(batches):
        common = sent.value
        for batch in batches:
            buf, off = _binary(batch.column(3))
            for a, b in _text.slices(off):
                v, at = rule.sets(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                size, rows = np.diff(at), np.repeat(np.arange(b - a), np.diff(at))
                c = common[(v >> _SHIFT).astype(np.int64)]
                keep = np.flatnonzero(c)
                keep = keep[np.lexsort((v[keep], c[keep], rows[keep]))]
                of = np.bincount(rows[keep], minlength=b - a)
                place = np.arange(len(keep)) - np.repeat(np.cumsum(of) - of, of)
                row = rows[keep]
                first = size + 1 + (-rule.percent * size) // 100  # so many of the first of all tokens
                take = place < (first - (size - of))[row]
                keep, row, after = keep[take], row[take], (of[row] - place)[take]
                columns = [batch.column(k).slice(a, b - a).take(pa.array(row)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(size[row]), pa.array(v[keep].view(np.int64)), pa.array(after)], ["id", "component", "asks", "n", "token", "after"])

    return run


def _packed(entries: Entries, bits: int):
    """Entries as rows (bucket, ids, nodes) of many: bucket is the upper bits of the nodes."""

    def pack(held):
        ids, nodes = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        bucket = (nodes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        kinds, first = np.unique(bucket[order], return_index=True)
        off = pa.py_buffer((np.append(first, len(ids)) * 8).astype(np.int32))
        blobs = [pa.Array.from_buffers(pa.binary(), len(kinds), [None, off, pa.py_buffer(x[order])]) for x in (ids, nodes)]
        return pa.RecordBatch.from_arrays([pa.array(kinds), *blobs], ["bucket", "ids", "nodes"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for ids, nodes in entries(batch):
                held.append((np.ascontiguousarray(ids, np.int64), np.ascontiguousarray(nodes, np.int64)))
                n += len(ids)
                if n >= PACK:
                    yield pack(held)
                    held, n = [], 0
        if n:
            yield pack(held)

    return run


def _chunks(batches, least):
    """(ids, nodes) of packed rows, least() of them at a time."""
    held, n = [], 0
    for batch in batches:
        both = [_binary(batch.column(k)) for k in (0, 1)]
        held.append([buf[off[0] : off[-1]].view(np.int64) for buf, off in both])
        n += len(held[-1][0])
        if n >= least():
            yield tuple(np.concatenate([h[k] for h in held]) for k in (0, 1))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate([h[k] for h in held]) for k in (0, 1))


def _met(small: int):
    """(id, node, null) of the nodes that two ids have, and (null, node, n) of those that more than ``small`` entries have.

    What is held are the distinct nodes with an id and a count each; a node's members stream past, however many there
    are.  An entry that comes twice may be told twice.
    """

    def run(batches):
        known, one, done, count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        for ids, nodes in _chunks(batches, lambda: max(PACK, len(known) // 2)):
            order = np.argsort(nodes)
            ids, nodes = ids[order], nodes[order]
            new = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
            each = np.diff(np.append(new, len(nodes)))
            kinds, low, high = nodes[new], np.minimum.reduceat(ids, new), np.maximum.reduceat(ids, new)
            at = np.searchsorted(known, kinds)
            at[at == len(known)] = 0
            old = known[at] == kinds if len(known) else np.zeros(len(kinds), bool)
            met, late = low != high, np.zeros(len(kinds), bool)
            if old.any():
                was, first = done[at], one[at]
                late = old & ~was & (met | (first != low))  # the id that came alone is told now
                met = np.where(old, was | late, met)
                count[at[old]] += each[old]
            take = np.repeat(met, each)
            columns = [pa.array(np.concatenate([ids[take], one[at[late]]])), pa.array(np.concatenate([nodes[take], kinds[late]]))]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.int64())], ["id", "node", "n"])
            done[at[late]] = True
            fresh = ~old
            known, one, done, count = (np.concatenate(x) for x in ((known, kinds[fresh]), (one, low[fresh]), (done, met[fresh]), (count, each[fresh])))
            order = np.argsort(known, kind="stable")
            known, one, done, count = known[order], one[order], done[order], count[order]
        large = np.flatnonzero(done & (count > small))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(large), pa.int64()), pa.array(known[large]), pa.array(count[large])], ["id", "node", "n"])

    return run


@dataclass
class Nodes:
    """rows(id, node); large(node, n): nodes of more members than are compared exhaustively, or None; members: of all
    large nodes; table: the written one that these read."""

    rows: DataFrame
    large: DataFrame | None
    few: bool = True
    members: int = 0
    table: DataFrame | None = None

    def part(self, large: bool) -> DataFrame:
        """The rows of large nodes, or of the others."""
        if self.large is None:
            return self.rows.limit(0) if large else self.rows
        return self.rows.join(F.broadcast(self.large) if self.few else self.large, "node", "left_semi" if large else "left_anti").select("id", "node")

    def sent(self):
        """The numbers of few large nodes, sorted, for all tasks."""
        held = np.sort(self.large.select("node").toArrow()["node"].to_numpy().view(np.uint64))
        return self.rows.sparkSession.sparkContext.broadcast(held)

    def drop(self) -> None:
        _spark.dropped(self.table)


def nodes_of(df: DataFrame, entries: Entries, each: float, small: int = SMALL, total: float | None = None) -> Nodes:
    """The nodes that two members at least have, in the shared folder.

    entries: from a batch of df to (ids, nodes), about ``each`` of them for each row; nodes are well mixed 64-bit
    numbers.  Entries move packed, by the upper bits of their nodes, and meet in tasks that hold distinct nodes only,
    which also tell the large ones.  total: how many entries there are, where that is known.
    """
    spark = df.sparkSession
    total = df.count() * each if total is None else total
    tasks = max(1, math.ceil(total / TASK_ENTRIES), min(spark.sparkContext.defaultParallelism, math.ceil(total / PACK)))
    bits = max(4, (4 * tasks).bit_length())
    packed = _spark.mapped(df, _packed(entries, bits), "bucket int, ids binary, nodes binary")
    table = _spark.written(_spark.mapped(packed.repartition(tasks, "bucket").select("ids", "nodes"), _met(small), "id bigint, node bigint, n bigint"))
    large = table.filter("id is null").select("node", "n")
    n, members = large.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Nodes(table.filter("id is not null").select("id", "node"), large if n else None, n <= BROADCAST_IDS, members, table)


def sent(table: DataFrame) -> DataFrame:
    """A written table, to be joined: it goes to all executors up to a checked number of rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in links(a, b): component is the smallest id that links reach.  Written."""
    edges = _spark.written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")))
    labels = _spark.written(edges.groupBy(F.col("u").alias("id")).agg(F.least("u", F.min("v")).alias("component")))
    few = labels.count() <= BROADCAST_IDS
    while True:
        all_over = F.broadcast(labels) if few else labels
        near = edges.join(all_over.select(F.col("id").alias("v"), "component"), "v").select(F.col("u").alias("id"), F.lit(None).cast("bigint").alias("was"), "component")
        step = labels.select("id", F.col("component").alias("was"), "component").union(near).groupBy("id").agg(F.max("was").alias("was"), F.min("component").alias("component"))
        up = all_over.select(F.col("id").alias("component"), F.col("component").alias("top"))
        step = _spark.written(step.join(up, "component", "left").select("id", "was", F.least("component", F.coalesce("top", "component")).alias("component")))
        _spark.dropped(labels)
        labels = step
        if not step.filter("component <> was").limit(1).count():
            _spark.dropped(edges)
            return labels.select("id", "component")


def left_join(rows: DataFrame, table: DataFrame, on: str, hot: DataFrame) -> DataFrame:
    """rows with the columns of table(on, ...), null where it has none; no key of many rows is dealt to one task.

    hot: the keys that many rows may have, at most one for each HOT rows; they go to all tasks, as the whole table does
    up to a checked number of rows.
    """
    if table.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(table), on, "left")
    keys = F.broadcast(hot.select(on).withColumn("_hot", F.lit(True)))
    both = rows.join(keys, on, "left")
    many = both.filter("_hot").drop("_hot").join(F.broadcast(table.join(keys, on, "left_semi")), on, "left")
    return many.unionByName(both.filter("_hot is null").drop("_hot").join(table, on, "left"))


def picked(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose key is among ids(id): ids go to all executors up to a checked number of them."""
    few = ids.count() <= BROADCAST_IDS
    ids = ids.select(F.col("id").alias(key))
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def link(small: DataFrame, large: DataFrame | None, sketches: DataFrame, texts: Callable[[DataFrame], DataFrame], rule: Similarity) -> tuple[DataFrame, DataFrame]:
    """(links(a, b), components(id, component)) of distinct texts.

    small, large: rows(id, node) of small and of large nodes, see Nodes; sketches(id, sketch): each text's sketch, of
    one length; texts(ids): (id, text binary) of ids.
    """
    held: list[DataFrame] = []
    try:
        return _linked(small, large, sketches, texts, rule, held)
    finally:
        _spark.dropped(*held)


def _linked(small: DataFrame, large: DataFrame | None, sketches: DataFrame, texts: Callable[[DataFrame], DataFrame], rule: Similarity, held: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """link(); held gets the tables that its result does not read."""

    def kept(df: DataFrame) -> DataFrame:
        held.append(_spark.written(df))
        return held[-1]

    def confirmed(pairs: DataFrame, whole: DataFrame, few: bool = True) -> DataFrame:
        if few:  # only texts of pairs move
            pairs = kept(pairs)
            whole = picked(whole, "id", kept(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()))
        both = pairs.join(whole.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(whole.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return _spark.mapped(both.select("a", "b", "ta", "tb"), _verified(rule), "a bigint, b bigint")

    def near_pivots(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        sample = rows.selectExpr("node", "id", "sketch", "row_number() OVER (PARTITION BY node ORDER BY xxhash64(id), id) AS k").filter(F.col("k") <= SAMPLE)
        pivots = kept(_spark.mapped(sample.groupBy("node").agg(F.collect_list(F.struct("id", "sketch")).alias("l")), _pivots, "node bigint, pivot bigint, pivot_sketch binary"))
        met = rows.join(pivots, "node").select("node", "id", "sketch", "pivot", "pivot_sketch")
        return pivots, kept(_spark.mapped(met, _near_pivot(rule.loose), "node bigint, id bigint, pivot bigint"))

    _spark.small_batches(small.sparkSession, 2000)
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    lists = small.join(sketches, "id").groupBy("node").agg(F.collect_list(F.struct("id", "sketch")).alias("l")).select("l")
    candidates = _spark.mapped(lists, _exhaustive(rule.loose), "a bigint, b bigint")
    pivots = near = None
    if large is not None:
        large = kept(large.join(sketches, "id").select("node", "id", "sketch"))
        pivots, near = near_pivots(large)
        candidates = candidates.union(near.select(*ordered("id", "pivot")))
    candidates = kept(candidates.distinct())
    ids = candidates.select(F.col("a").alias("id")).union(candidates.select("b"))
    whole = kept(texts(kept((ids if large is None else ids.union(large.select("id"))).distinct())))
    links = _spark.written(confirmed(candidates, whole, few=False))
    if large is None:
        return links, components(links)
    # where many members are left that no pivot has joined, they get pivots of their own, as long as that joins many
    todo, n = large, large.count()
    for _ in range(ROUNDS - 1):
        told = near.select("node", "id", *ordered("id", "pivot")).join(sent(links), ["a", "b"]).select("node", "id")
        told = kept(told.union(pivots.select("node", F.col("pivot").alias("id"))))
        rest = todo.join(sent(told), ["node", "id"], "left_anti")
        many = rest.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > MIDDLE).select("node")
        todo, before = kept(rest.join(many, "node", "left_semi")), n
        n = todo.count()
        if not n or 4 * n > 3 * before:
            break
        pivots, near = near_pivots(todo)
        more = confirmed(near.select(*ordered("id", "pivot")).distinct(), whole)
        held.append(links)
        links = _spark.written(links.union(more).distinct())
    found = components(links)
    more = _late_links(large, found, whole, rule, kept, confirmed)
    if more is None:
        return links, found
    # the new links join components
    place = sent(found)
    ends = more.join(place.toDF("a", "ca"), "a", "left").join(place.toDF("b", "cb"), "b", "left")
    ends = kept(ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")))
    joined = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b").distinct())
    known = found.union(ends.select("a", "ca")).union(ends.select("b", "cb")).distinct()
    final = known.join(sent(joined).toDF("component", "top"), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return links.union(more).distinct(), _spark.written(final)


def _late_links(large: DataFrame, found: DataFrame, whole: DataFrame, rule: Similarity, kept, confirmed) -> DataFrame | None:
    """Links(a, b) of members of large nodes outside their node's main component to members of other components.

    Nodes of up to MIDDLE members and NODE_BYTES compare these with all others.  The rest have an exact join of sets: of
    two similar sets, in any order of all tokens, the first tokens meet, and what follows the first common one must
    still hold the overlap that is asked for.  Tokens that no text that asks has come first in the order, then rare
    ones by a table of counts of fixed size, so what many texts have in common is hardly ever looked at.  None without
    any link.
    """
    placed = kept(large.select("node", "id").join(sent(found), "id", "left").select("node", "id", F.coalesce("component", "id").alias("component")))
    shares = placed.groupBy("node", "component").agg(F.count("*").alias("n"))
    split = shares.groupBy("node").agg(F.count("*").alias("parts"), F.sum("n").alias("members"), F.max_by("component", F.struct("n", -F.col("component"))).alias("main")).filter("parts > 1")
    split = kept(split)
    if not split.limit(1).count():
        return None
    sizes = sent(kept(whole.select("id", F.octet_length("text").alias("size"))))
    rest = placed.join(sent(split), "node").join(sizes, "id").select("node", "id", "component", (F.col("component") != F.col("main")).alias("asks"), "members", "size")
    rest = kept(rest)
    middle = kept(rest.groupBy("node").agg(F.any_value("members").alias("n"), F.sum("size").alias("bytes")).filter((F.col("n") <= MIDDLE) & (F.col("bytes") <= NODE_BYTES)).select("node"))
    few = middle.count() <= BROADCAST_IDS
    part = lambda how: rest.join(F.broadcast(middle) if few else middle, "node", how)
    among = kept(part("left_semi"))
    lists = among.join(picked(whole, "id", kept(among.select("id").distinct())), "id").groupBy("node").agg(F.collect_list(F.struct("id", "component", "asks", "text")).alias("l")).select("l")
    more = _spark.mapped(lists, _asked(rule), "a bigint, b bigint")
    members = kept(part("left_anti").groupBy("id", "component").agg(F.bool_or("asks").alias("asks")))
    if members.limit(1).count():
        more = more.union(confirmed(_common_fronts(members, whole, rule, kept).distinct(), whole))
    more = _spark.written(more.distinct())
    return more if more.limit(1).count() else None


def _common_fronts(rest: DataFrame, whole: DataFrame, rule: Similarity, kept) -> DataFrame:
    """Pairs(a, b) of rest(id, component, asks), of two components and one at least that asks, that may be similar."""
    rows = kept(picked(whole, "id", rest.select("id")).join(rest, "id").select("id", "component", "asks", "text"))
    counts = _spark.mapped(rows, _cells(rule), "cell bigint, n bigint, asked bigint").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked")).filter("asked > 0").select("cell", "n").toArrow()
    common = np.zeros(CELLS, np.int64)
    common[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(common)
    each = kept(_spark.mapped(rows, _fronts(rule, sent), "id bigint, component bigint, asks boolean, n bigint, token bigint, after bigint"))
    p, n = rule.percent, F.col("n")
    least = F.ceil(n * p / 100).cast("bigint")  # the smallest set that is similar enough
    most = F.floor(F.col("after") * (100 + p) / p).cast("bigint") - n  # the largest one with which the overlap can be enough
    kind = lambda x: F.floor(F.log(x.cast("double")) * 10).cast("int")  # noqa: E731  sets of one kind are within a tenth in size
    asking = each.filter("asks").withColumn("most", most).filter(F.col("most") >= least)
    asking = asking.select(F.col("id").alias("x"), n.alias("nx"), F.col("component").alias("cx"), "token", F.col("after").alias("ax"), F.explode(F.sequence(kind(least), kind(F.col("most")))).alias("kind"))
    pairs = asking.join(each.withColumn("kind", kind(n)), ["token", "kind"]).filter("cx <> component")
    pairs = pairs.filter(F.least("ax", "after") * (100 + p) >= p * (F.col("nx") + n))
    return pairs.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))
