from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from budgetlens.llm import _links, near_dedup
from tests.llm.helpers import ODD, clashing, components, corpus, documents


def words(text):
    out = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def sets(texts, size=4):
    out = []
    for t in texts:
        w = words(t)
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def brute(texts):
    bags = sets(texts)
    linked = [(i, j) for (i, a), (j, b) in combinations(enumerate(bags), 2) if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    return bags, components(len(texts), linked)


@pytest.mark.parametrize("seed", [3, 4])
def test_components_equal_brute_force(spark, seed):
    texts = corpus(seed) + ODD
    bags, comp = brute(texts)
    rows = {r["doc_id"]: r for r in near_dedup.near_duplicates(documents(spark, texts).repartition(3)).collect()}
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == [len(b) for b in bags]
    assert [rows[i]["component_id"] for i in range(len(texts))] == comp
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows.values())


def test_large_nodes_equal_brute_force(spark):
    """A family around one text whose members are less alike among themselves than to it, and some chains."""
    import random

    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    for i in range(0, 24, 2):
        texts.append(" ".join([*base[i:], *[f"y{k}" for k in range(i)]]))
    texts.append(" ".join(base))
    assert len(texts) > 2 * _links.SMALL
    _, comp = brute(texts)
    rows = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == comp


def test_repeated_rows_null_keys_and_clashing_columns(spark):
    rows = near_dedup.near_duplicates(documents(spark, ["a b c d e", "a b c d e", "A b c d e"], [7, 7, 9])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows) == [(7, 7, False), (7, 7, True), (9, 7, False)]
    rows = near_dedup.near_duplicates(documents(spark, ["a b c d e", "a b c d e"], [None, 3])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in rows} == {(None, None, True), (3, 3, True)}
    docs = clashing(spark, ["a b c d", "a b c d"], ["component_id", "kept", "id", "n", "node", "rep"])
    assert {r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == {0}
    assert near_dedup.near_duplicates(documents(spark, ["x"]).limit(0)).count() == 0


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 99)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in _links.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99, 101: 99}


@pytest.mark.parametrize("middle", [512, 0])
def test_families_under_the_threshold_equal_brute_force(spark, monkeypatch, middle):
    """Texts that share most of a template without being similar, and a few that are, late in large nodes."""
    import random

    monkeypatch.setattr(_links, "MIDDLE", middle)
    rng = random.Random(11)
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for shared, own in ((100, 24), (90, 16)):
        base = fresh(shared)
        family = [[*base, *fresh(own + rng.randint(-6, 6))] for _ in range(45)]
        texts += family
        for copy in family[:12]:
            copy = list(copy)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(shared, len(copy))] = fresh(1)[0]
            texts.append(copy)
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    _, comp = brute(texts)
    assert len(set(comp)) > 20
    rows = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == comp


def test_rows_of_one_key_are_documents_of_their_own(spark, monkeypatch):
    rows = [(1, "a b c d e f"), (2, "z b c d e f"), (2, "A B c d e f"), (None, "a b c d e f"), (None, None), (3, "z b c d e f"), (2, None), (7, "p q r s t"), (7, "u v w x y")]
    for limit in (1_000_000, 0):
        monkeypatch.setattr(_links, "BROADCAST_IDS", limit)
        monkeypatch.setattr(_links, "HOT", 1)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept", F.lit("?"))
        got = near_dedup.near_duplicates(df).collect()
        want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 2, True), (3, 3, 2, False), (2, 0, 2, True), (7, 2, 7, True), (7, 2, 7, True), (0, 3, 0, True), (0, 0, 0, True)]
        assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in got) == sorted(want)
        stay = sorted((r["doc_id"] or 0, r["text"] or "") for r in near_dedup.without_near_duplicates(df).collect())
        assert stay == sorted((i or 0, t or "") for i, t in rows if (i, t) not in ((2, "A B c d e f"), (3, "z b c d e f")))


def test_equal_sets_of_other_order_meet_by_confirmed_links(spark):
    """Only texts of equal words are one class unseen; equal sets of other order are linked like any other pair."""
    texts = ["a b c d a b c d e", "a b c d e", "b c d a b c d e a b c d", "A  b\tc D e", "q"]
    bags, comp = brute(texts)
    rows = {r["doc_id"]: r for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert [rows[i]["component_id"] for i in range(len(texts))] == comp and [rows[i]["n_shingles"] for i in range(len(texts))] == [len(b) for b in bags]


def test_lower_levels_are_found_without_moving_documents(spark):
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 3, (400, near_dedup.TOKENS)).astype(np.uint32)
    rows = [(i, bytearray(t.tobytes())) for i, t in enumerate(tokens)]
    reps = spark.createDataFrame(rows, "id bigint, tokens binary").repartition(3).persist()
    first = _links.nodes_of(reps, near_dedup._paths(2, []), 2.5)
    counts = {r["node"]: r["n"] for r in first.rows.groupBy("node").count().withColumnRenamed("count", "n").collect()}
    large = {r["node"]: r["n"] for r in first.large.collect()}
    assert large == {k: n for k, n in counts.items() if n > _links.SMALL} and first.members == sum(large.values()) > 0
    moved = _links.nodes_of(first.part(True).join(reps, "id").select("id", "node", "tokens"), near_dedup._branches, 1.25)
    own = _links.nodes_of(reps, near_dedup._paths(2, [first.sent()]), 1.25, total=first.members * 1.25)
    assert own.rows.count() > 0 and sorted(own.rows.collect()) == sorted(moved.rows.collect())


def test_steps_over_few_ids_are_not_dealt_out_by_them(spark):
    """A round of labels is one shuffle."""
    links = _links._spark.written(spark.createDataFrame([(i, i + 1) for i in range(6)], "a bigint, b bigint"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.java.util.ArrayList()

    def tasks():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), none)
        return sum(stages.apply(i).numCompleteTasks() for i in range(stages.size()))

    for k, v in zip(was, ("50", "false", "-1")):
        spark.conf.set(k, v)
    try:
        before = tasks()
        assert {r["component"] for r in _links.components(links).collect()} == {0}
        assert tasks() - before < 350  # four rounds and the first labels
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
