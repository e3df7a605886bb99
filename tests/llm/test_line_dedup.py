from itertools import combinations

import pytest

from budgetlens.llm import line_dedup
from tests.llm.helpers import ODD, clashing, components, corpus, documents


def brute(texts, size=8):
    lines = [(d, i, t) for d, text in enumerate(texts) for i, t in enumerate((text or "").split("\n")) if t.strip(" \t\n\x0b\x0c\r")]
    bags = [{t[i : i + size] for i in range(max(1, len(t) - size + 1))} for _, _, t in lines]
    linked = [(i, j) for (i, a), (j, b) in combinations(enumerate(bags), 2) if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b)]
    comp = components(len(lines), linked)
    return {(d, i): lines[comp[n]][:2] for n, (d, i, _) in enumerate(lines)}


@pytest.mark.parametrize("seed", [3, 6])
def test_components_equal_brute_force(spark, seed):
    texts = corpus(seed, 60, 4) + ODD
    got = {(r["doc_id"], r["line"]): r for r in line_dedup.duplicate_lines(documents(spark, texts).repartition(3)).collect()}
    want = brute(texts)
    assert {k: (r["component_key"], r["component_line"]) for k, r in got.items()} == want
    assert all(r["kept"] == (want[k] == k) for k, r in got.items())


def test_fingerprint_clashes_are_told_apart(spark, monkeypatch):
    """Classes that share the first fingerprint are known by the second."""
    import numpy as np

    plain = line_dedup._prints
    monkeypatch.setattr(line_dedup, "_prints", lambda *a: (np.zeros_like(plain(*a)[0]), plain(*a)[1]))
    texts = ["one line here\ntwo lines there", "one line here", "another thing"]
    got = {(r["doc_id"], r["line"]): (r["component_key"], r["component_line"]) for r in line_dedup.duplicate_lines(documents(spark, texts)).collect()}
    assert got == brute(texts)


def test_texts_without_repeated_lines(spark):
    texts = ["Keep this line.\nTwice written line.", "Twice written line.", "Twice written line.\n\nOwn line of it.", None, "", " \n"]
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_duplicates(documents(spark, texts)).collect()}
    assert out == {0: texts[0], 2: "\nOwn line of it.", 3: None, 4: "", 5: " \n"}


def test_null_and_repeated_keys(spark):
    """Rows are told apart whatever their keys: links hold, and each row loses its own lines only."""
    texts = corpus(5, 40, 3)
    same = "The quick brown fox jumps over the lazy dog by the river."
    texts += [same + "\nA first row's own line, kept.", "Another opening of some text here.\n" + same.replace("lazy", "lame"), "Third row's start is unlike others.\n" + same.replace("lazy", "hazy"), None, "", same]
    groups = brute(texts)
    of = lambda n: "\n".join(t for i, t in enumerate((texts[n] or "").split("\n")) if groups.get((n, i), (n, i)) == (n, i))
    for ids in ([None] * len(texts), [1] * len(texts), [None, None, *[n // 3 for n in range(2, len(texts))]], [None, *range(1, len(texts))]):
        # in one partition rows are numbered as they come
        docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").coalesce(1)
        rows = line_dedup.duplicate_lines(docs).collect()
        want = sorted((-1 if ids[d] is None else ids[d], i, -1 if ids[c] is None else ids[c], at, (c, at) == (d, i)) for (d, i), (c, at) in groups.items())
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["line"], -1 if r["component_key"] is None else r["component_key"], r["component_line"], r["kept"]) for r in rows) == want
        out = line_dedup.without_duplicates(docs)
        stay = sorted((-1 if k is None else k, str(texts[n] if texts[n] is None else of(n))) for n, k in enumerate(ids) if of(n).strip() or not texts[n])
        assert out.columns == ["doc_id", "text"] and sorted((-1 if r["doc_id"] is None else r["doc_id"], str(r["text"])) for r in out.collect()) == stay


def test_empty_table_and_clashing_columns(spark):
    assert line_dedup.duplicate_lines(documents(spark, ["x"]).limit(0)).count() == 0
    docs = clashing(spark, ["a line\na line", "b"], ["line", "kept", "doc", "f1", "id", "copies"])
    assert line_dedup.duplicate_lines(docs).count() == 3
    out = line_dedup.without_duplicates(docs)
    assert out.columns == docs.columns and {r["text"] for r in out.collect()} == {"a line", "b"}


def test_lines_are_taken_out_whatever_other_columns_are_called(spark):
    names = ["_key", "_gone", "_new", "_own", "_text", "_row", "doc", "line"]
    docs = clashing(spark, ["A first line here\nsecond", "A first line here\nother", None, "A first line here"], names)
    got = {r["doc_id"]: r.asDict() for r in line_dedup.without_duplicates(docs).collect()}
    assert {k: r["text"] for k, r in got.items()} == {0: "A first line here\nsecond", 1: "other", 2: None}
    assert all(r[n] == "?" for r in got.values() for n in names)


def test_rows_of_one_key_lose_their_own_lines_only(spark):
    rows = [(1, "A repeated line\nsecond one"), (7, "A repeated line\nxx"), (7, "precious text\nother one"), (None, "A repeated line\nkept here"), (None, "second one")]
    got = [r["text"] for r in line_dedup.without_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    lines = sorted(x for t in got for x in t.split("\n"))
    assert lines == sorted({x for _, t in rows for x in t.split("\n")})
