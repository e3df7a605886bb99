import random

from pyspark.sql import functions as F

from budgetlens.llm import _tokens
from budgetlens.llm import token_counts as C
from tests.llm.helpers import ODD, clashing, corpus, documents

PATH = _tokens.vocabulary("byte_bpe_50k.tiktoken")


def test_edits_equal_a_full_count():
    counter, rng = _tokens.PieceCounter.of(PATH), random.Random(1)
    for _ in range(400):
        text = "".join(rng.choices(list("aab  '\n\tsr1é.e’ "), k=rng.choice([0, 1, 5, 50, 400, 3000])))
        chars, tokens = C.leaves(counter, text)
        tree = C.Tree(chars.tolist(), tokens.tolist())
        for _ in range(4):
            a = rng.randint(0, len(text))
            b, new = min(len(text), a + rng.choice([0, 0, 1, 5, 200])), "".join(rng.choices(list("a 's\n1"), k=rng.choice([0, 1, 3, 100])))
            want = text[:a] + new + text[b:]
            text, _ = C.edited(counter, text, tree, a, b, new)
            assert text == want and tree.totals() == (len(text), len(counter.encoding.encode_ordinary(text)))
            for below, above in zip(tree.levels, tree.levels[1:]):
                for k in (0, 1):
                    assert above[k] == [sum(below[k][i : i + C.FAN]) for i in range(0, len(below[k]), C.FAN)]


def test_only_the_region_of_an_edit_is_encoded():
    counter = _tokens.PieceCounter.of(PATH)
    text = " ".join(f"word{i}" for i in range(20_000))
    chars, tokens = C.leaves(counter, text)
    _, encoded = C.edited(counter, text, C.Tree(chars.tolist(), tokens.tolist()), 70_000, 70_003, "changed")
    assert encoded < 2_000


def test_tables_of_edits(spark):
    texts = corpus(1, 20) + ODD
    state = C.build(documents(spark, texts).repartition(3), PATH)
    counter = _tokens.PieceCounter.of(PATH)
    count = lambda t: len(counter.encoding.encode_ordinary(t))
    assert {r["doc_id"]: r["n_tokens"] for r in state.collect()} == {i: count(t or "") for i, t in enumerate(texts)}
    odd = len(texts) - len(ODD)
    changes = spark.createDataFrame([(0, 2, 0, 1, "second"), (0, 1, 5, 9, ""), (odd, 1, 0, 0, "from null"), (3, 1, None, None, None), (10**6, 1, 0, 0, "gone")], "doc_id bigint, turn int, start bigint, stop bigint, text string")
    out = {r["doc_id"]: r for r in C.apply_edits(C.with_edits(state, changes), PATH).collect()}
    first = texts[0][:5] + texts[0][9:]
    assert out[0]["text"] == "second" + first[1:] and out[odd]["text"] == "from null" and out[3]["text"] == texts[3] and out[odd + 1]["text"] == texts[odd + 1]
    assert all(r["n_tokens"] == count(r["text"] or "") and sum(r["leaf_tokens"] or []) == r["n_tokens"] and "edits" not in r for r in out.values())


def test_query_equals_full_counts(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    count = lambda t: len(_tokens.PieceCounter.of(PATH).encoding.encode_ordinary(t))
    for r in C.op10_edit_aware_counts(spark, data).collect():
        t = docs[r["doc_id"]]
        n = len(t)
        after = t[: n // 3] + "Δ it's" + t[min(n, n // 3 + 5) :]
        at = min(len(after), 2 * (n // 3))
        after = after[:at] + " inserted words, 42 " + after[at:]
        after = after[: max(0, n - 7)] + after[n:]
        assert (r["tokens_before"], r["tokens_after"]) == (count(t), count(after))


def test_repeated_rows_empty_table_and_clashing_columns(spark):
    assert C.build(documents(spark, ["x"]).limit(0), PATH).count() == 0
    state = C.build(clashing(spark, ["one two", None], ["n_tokens", "leaf_chars", "reencoded_chars"]), PATH)
    out = C.apply_edits(state.withColumn("edits", F.lit(None).cast(C.EDITS)), PATH)
    assert sorted(r["n_tokens"] for r in out.collect()) == [0, 2] and out.columns.count("reencoded_chars") == 1


def test_null_keys_and_repeated_rows(spark):
    """Each row stands for itself, whatever its key; edits of a key reach all rows of it."""
    rows = spark.createDataFrame([(None, "one two three"), (None, "one two three"), (5, "one two"), (5, "one two"), (6, None)], "doc_id bigint, text string")
    state = C.build(rows, PATH)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in state.collect()) == [(0, 3), (0, 3), (5, 2), (5, 2), (6, 0)]
    changes = spark.createDataFrame([(5, 1, 0, 3, "a b c"), (6, 1, 0, 0, "new"), (9, 1, 0, 0, "lost")], "doc_id bigint, turn int, start bigint, stop bigint, text string")
    out = C.apply_edits(C.with_edits(state, changes), PATH)
    assert sorted((r["doc_id"] or 0, r["text"], r["n_tokens"]) for r in out.collect()) == [(0, "one two three", 3), (0, "one two three", 3), (5, "a b c two", 4), (5, "a b c two", 4), (6, "new", 1)]
