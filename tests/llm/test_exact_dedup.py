import hashlib

import pytest

from budgetlens.llm import exact_dedup as E
from tests.llm.helpers import ODD, clashing, corpus, documents
from tests.oracle import agree


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute(rows):
    out = {}
    for d, t in rows:
        out.setdefault(low(t), []).append(d)
    return {(d, max(out[low(t)]), len(out[low(t)]), d == max(out[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for d, t in rows}


def test_groups_equal_brute_force(spark):
    long = "Some words that go on. " * 3000
    texts = corpus(2, 60) + ODD + [long, long.upper(), long + "x", "ÄB", "äb", "Äb", "İ"]
    got = E.exact_duplicates(documents(spark, texts).repartition(3)).collect()
    assert {tuple(r) for r in got} == brute(list(enumerate(texts))) and len(got) == len(texts)


def test_query_agrees_with_its_sql(spark, data):
    agree(E.op7_chunk_recipes, E.OP7_SQL, spark, data)


def test_chunks_depend_on_content_only():
    import numpy as np

    rng = np.random.default_rng(1)
    body = rng.integers(32, 127, 50_000).astype(np.uint8)
    lists = []
    for front in (b"", b"different beginning " * 40):
        buf = np.concatenate([np.frombuffer(front, np.uint8), body])
        (ends,) = E.cuts(buf, np.array([0, len(buf)]), 10, 256, 8192)
        lists.append({e - len(front) for e in ends})
        sizes = np.diff([0, *ends])
        assert ends[-1] == len(buf) and sizes.max() <= 8192 and sizes[:-1].min() >= 256
    assert len(lists[0] & lists[1]) > 0.9 * len(lists[0])


def test_clashing_identifiers_are_noticed_and_made_anew(spark):
    def weak(body, key):
        return b"\0" * E.ID_BYTES if key == 0 else E.chunk_id(body, key)

    texts = ["one", "two", "ONE"]
    got = {tuple(r) for r in E.exact_duplicates(documents(spark, texts), identify=weak).collect()}
    assert got == brute(list(enumerate(texts)))
    with pytest.raises(RuntimeError):
        E.exact_duplicates(documents(spark, texts), identify=lambda body, key: b"\0" * E.ID_BYTES)


def test_repeated_rows_null_keys_empty_table_and_clashing_columns(spark):
    rows = E.exact_duplicates(documents(spark, ["a", "A", "b", None], [4, 4, None, 2])).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in rows) == [(0, None, 1, True), (2, 2, 1, True), (4, 4, 2, True), (4, 4, 2, True)]
    assert E.exact_duplicates(documents(spark, ["x"]).limit(0)).count() == 0
    assert E.exact_duplicates(clashing(spark, ["x", "X"], ["recipe", "keep_id", "_n"])).filter("kept").count() == 1


def test_large_groups_are_told_without_moving_their_rows(spark, monkeypatch):
    texts = ["big"] * 30 + ["pair", "PAIR", "one", None, ""]
    whole = {tuple(r) for r in E.exact_duplicates(documents(spark, texts)).collect()}
    monkeypatch.setattr(E, "HOT", 5)
    assert {tuple(r) for r in E.exact_duplicates(documents(spark, texts)).collect()} == whole and len(whole) == len(texts)
