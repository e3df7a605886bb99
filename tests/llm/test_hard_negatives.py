import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm import _spark
from budgetlens.llm import hard_negatives as H

VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain(rows, is_anchor, positives=5, negatives=3):
    """The contract, by comparing all anchors with all rows."""
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * float(np.float32(x))) for x in v]
            good[i] = max(good.get(i, (label, q)), (label, q))
    out = []
    for a, (label, q) in good.items():
        if not is_anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(q, r)) for i, (_, r) in good.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if good[i][0] == label][:positives]:
            fits = [i for i in order if good[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:negatives]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fits)]
    return sorted(out)


def run(spark, rows, every, **how):
    out = H.hard_negatives(spark.createDataFrame(rows, VECTORS), "embedding", F.col("vec_id") % every == 0, **how)
    return sorted(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def vectors(n, dim, labels, seed, spread=1.0):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [b + rng.gauss(0, spread) for b in rng.choice(base)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize(("block", "labels", "spread"), [(8192, 3, 1.0), (40, 4, 0.2), (25, 2, 0.05)])
def test_negatives_equal_brute_force_in_one_cell_and_in_many(spark, monkeypatch, block, labels, spread):
    monkeypatch.setattr(H, "SAMPLE_CELL", 8)
    rows = vectors(400, 6, labels, block, spread)
    got = run(spark, rows, 20, block=block)
    assert got and got == plain(rows, lambda i: i % 20 == 0)


def test_ties_and_a_third_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(H, "SAMPLE_CELL", 8)
    rng = random.Random(5)
    rows = [(i, [1.0, 0.5] if i % 3 == 0 else [rng.randint(-2, 2) / 4, rng.randint(-2, 2) / 4], i % 2) for i in range(240)]
    assert run(spark, rows, 10, block=30) == plain(rows, lambda i: i % 10 == 0)


def test_rows_that_take_no_part_repeated_keys_ragged_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = vectors(60, 3, 2, 9) + [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [nan, 1.0, 1.0], 0), (103, [inf, 1.0, 1.0], 0), (104, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(5, [3.0, 3.0, 3.0], 1), (5, [3.0, 3.0, 3.0], 1), (105, [], 0), (110, [2.0], 1)]
    assert run(spark, rows, 5) == plain(rows, lambda i: i % 5 == 0)


def test_no_rows_no_anchors_and_clashing_columns(spark):
    assert run(spark, [], 5) == [] and run(spark, [(1, None, 1)], 5) == []
    assert run(spark, [(i + 1, v, y) for i, v, y in vectors(30, 3, 2, 1)], 1000) == []
    names = ["cell", "share", "anchor", "unit", "q", "norm", "x"]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in names]])
    rows = vectors(50, 3, 2, 4)
    df = spark.createDataFrame([(*r, *["?"] * len(names)) for r in rows], schema)
    assert sorted(map(tuple, H.hard_negatives(df, "embedding", F.col("vec_id") % 5 == 0).collect())) == plain(rows, lambda i: i % 5 == 0)


def test_scores_beyond_floating_point_stay_exact_and_too_large_ones_raise():
    x = np.array([[2**26 + 1, 3], [2**26 - 1, 5]])
    assert H._scores(x, x).tolist() == [[(2**26 + 1) ** 2 + 9, 2**52 - 1 + 15], [2**52 - 1 + 15, (2**26 - 1) ** 2 + 25]]
    with pytest.raises(ValueError):
        H._scores(np.array([[2**40]]), np.array([[2**40]]))


def test_traversal_skips_what_the_annulus_excludes():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-5, 5, (256, 4)) + c for c in ([200, 0, 0, 0], [0, 200, 0, 0], [0, 0, 200, 0], [0, 0, 0, 200])])
    top = float((x.astype(float) ** 2).sum(1).max())
    tree = H.Tree(x, top, 64)
    near, far = tree.bounds(x[:4], top)
    score = H._scores(x[:4], x)
    for leaf in range(len(tree.path)):
        d = H._distance((x[:4].astype(float) ** 2).sum(1)[:, None], top, score[:, tree.order[tree.starts[leaf] : tree.starts[leaf + 1]]])
        assert (near[:, leaf] <= d.min(1)).all() and (far[:, leaf] >= d.max(1)).all()
    window = H._distance((x[:4].astype(float) ** 2).sum(1), top, np.full(4, 30_000))
    assert (near > window[:, None]).mean() > 0.4  # leaves that a window of high scores never visits


def test_the_sample_is_cut_before_rows_go_to_the_driver(spark):
    df = spark.range(20_000).select(F.col("id").alias("vec_id"))
    exact = [r["vec_id"] for r in df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(500).collect()]
    assert [r["vec_id"] for r in _spark.first_by_hash(df, "vec_id", 20_000, 500).collect()] == exact
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    near = _spark.below_hash(df, "vec_id", 20_000, 500).mapInArrow(counted, "vec_id bigint")
    assert near.count() == seen.value < 1000
    assert _spark.first_by_hash(df, "vec_id", 20_000, 50_000).count() == 20_000


def test_neither_chunks_nor_blocks_go_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(H, "SAMPLE_CELL", 8)
    made = H.index(spark.createDataFrame(vectors(400, 6, 3, 2), VECTORS), "embedding", block=40)
    units = made.rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("anchor"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("unit"), "label", F.lit(-(2**40)).alias("low"), F.lit(2**40).alias("high"), "x")
    plans, written = [], _spark.written

    def seen(df, *rows):
        out = written(df, *rows)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(_spark, "written", seen)
    # files tell little of a size: vectors that many cells have are compressed, and chunks are repeated after they are read
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    found = made.nearest(units, 3, True)
    joins = [p for p in plans if "xs#" in p and "rows#" in p]
    assert len(joins) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in joins)
    best = {}
    for r in found.collect():
        best.setdefault((r["anchor"], r["unit"]), []).append((-r["score"], r["vec_id"]))
    assert len(best) == 40 and all(sorted(best[a, 1]) == sorted(best[a, 2]) for a, _ in best)


def test_whole_scores_take_the_quickest_exact_type():
    rng = np.random.default_rng(6)
    for most, kind in ((500, np.float32), (2**20, np.float64), (2**26, np.int64)):
        x = rng.integers(-most, most, (900, 5))
        x[0, 0] = -most
        assert H._kind(x, x)[0] is kind
        top, ids, labels = float((x.astype(float) ** 2).sum(1).max()), np.arange(900), np.arange(900) % 3
        q, who, full = x[:30], ids[:30], x[:30] @ x.T
        high = np.where(who % 2 == 0, H.FAR, full.max(1) // 2)
        low = np.where(who % 5 == 0, full.max(1) // 4, -H.FAR)
        unit, vec, score = H.search(H.Tree(x, top, 64), x, ids, labels, q, who, labels[:30], low, high, 4, False, top)
        for u in range(30):
            fits = [i for i in np.lexsort((ids, -full[u])) if labels[i] != labels[u] and low[u] <= full[u, i] <= high[u]][:4]
            assert sorted(zip(-score[unit == u], vec[unit == u])) == [(-full[u, i], i) for i in fits]
