import hashlib
import math
import zlib

import pytest

from budgetlens.llm import sharding as R
from tests.llm.helpers import ODD, clashing, documents


def owner(key, weights):
    digest = hashlib.md5(str(key).encode() if key is not None else b"").hexdigest()
    h1, h2, h3 = (int(digest[8 * k : 8 * k + 8], 16) % R.PRIME for k in range(3))
    best = []
    for j, w in enumerate(weights):
        a, b = R._constants(j)
        v = (h1 * a + h2) % R.PRIME
        u = ((v * v + h3) % R.PRIME * b + h2) % R.PRIME
        best.append((-w / math.log((u + 1) / (R.PRIME + 1)), -j))
    return -max(best)[1]


def test_shards_equal_a_plain_model_and_slots_have_no_gaps(spark):
    texts = ODD * 20
    rows = R.shards(documents(spark, texts).repartition(3), "doc_id", "text", [1.0] * 24, [1.0] * 25, buckets=4).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["shard"] == owner(r["doc_id"], [1.0] * 24) and r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 24)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shares_follow_weights_and_few_keys_move(spark):
    n = 40_000
    counts = {r["shard"]: r["count"] for r in R.assign(spark.range(n), "id", [1.0, 2.0, 3.0]).groupBy("shard").count().collect()}
    assert all(counts[s] == pytest.approx(n * (s + 1) / 6, rel=0.05) for s in range(3))
    before = {r["id"]: r["shard"] for r in R.assign(spark.range(n), "id", [1.0] * 24).select("id", "shard").collect()}
    after = {r["id"]: r["shard"] for r in R.assign(spark.range(n), "id", [1.0] * 25).select("id", "shard").collect()}
    moved = [k for k in before if before[k] != after[k]]
    assert {after[k] for k in moved} == {24} and len(moved) == pytest.approx(n / 25, rel=0.1)
    sizes = [list(before.values()).count(s) for s in range(24)]
    assert sum((s - n / 24) ** 2 / (n / 24) for s in sizes) < 60


def test_null_keys_repeated_rows_empty_table_and_clashing_columns(spark):
    rows = R.shards(documents(spark, ["a", "a", "b"], [None, None, 3]), "doc_id", "text", [1.0] * 5).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == 3 and {r["grown_shard"] for r in rows} == {None}
    assert R.shards(documents(spark, ["x"]).limit(0), "doc_id", "text", [1.0] * 24).count() == 0
    assert R.shards(clashing(spark, ["x", None], ["shard", "slot", "_h1", "_key"]), "doc_id", "text", [1.0] * 24).count() == 2
