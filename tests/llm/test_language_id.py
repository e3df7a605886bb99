import numpy as np
from pyspark.sql import functions as F

from budgetlens.llm import language_id as L
from tests.llm.helpers import ODD, clashing, documents


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.op5_language_nb(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and 0.1 < len(held) / len(rows) < 0.3
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_scores_equal_a_plain_model(spark):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "de"), (4, "x", None)], "doc_id bigint, text string, lang string")
    model = L.train(train)
    assert model.languages == ["de", "en"]
    text = "Der Hund-7!"
    sym = [0, *map(ord, "der"), 0, *map(ord, "hund"), 0]
    cells = [c for col in L.cells(np.array(sym, np.uint32), np.array([0, len(sym)])) for c in col.tolist() if c >= 0]
    assert len(cells) == sum(len(sym) - n + 1 for n in L.ORDERS)
    sums = model.weights[cells].astype(np.float64).sum(0) / np.sqrt(len(sym) * len(L.ORDERS))
    p = np.exp(sums - sums.max())
    row = L.predict(documents(spark, [text]), model).first()
    assert row["lang_pred"] == "de" and abs(row["score"] - p[0] / p.sum()) < 1e-6


def test_odd_texts_and_batches(spark):
    model = L.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    one = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(documents(spark, ODD).repartition(1), model).collect()}
    many = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(documents(spark, ODD).repartition(5), model).collect()}
    assert one == many and one[0] == one[1] == one[2] == one[9] == ("und", 0.0) and one[7] == one[8]
    assert one[3][0] != "und" and one[4][0] != "und"


def test_no_labels_empty_table_sample_and_clashing_columns(spark):
    none = L.train(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert L.predict(documents(spark, ["abc"]), none).first()["lang_pred"] == "und"
    assert L.predict(documents(spark, ["abc"]).limit(0), none).count() == 0
    docs = clashing(spark, ["abc"], ["lang_pred", "score", "_text"])
    assert L.predict(docs, none).columns == ["doc_id", "lang_pred", "score"]
    kept = L.predict(docs, none, keep=("text", "score"), names=("a", "b"))
    assert kept.columns == ["doc_id", "text", "score", "a", "b"] and kept.first()["text"] == "abc"
    some = L.train(spark.range(400).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.lit("en").alias("lang")), sample_rows=40)
    assert some.languages == ["en"]


def test_any_number_of_languages(spark):
    """Each language has letters of its own, and each text is told from all others, as by a plain matrix."""
    names = [f"l{n:03}" for n in range(300)]
    word = lambda n: "".join(chr(0x4E00 + 20 * n + k) for k in (0, 3, 7, 11, 2))
    rows = [(n, f"{word(n)} {word(n)[::-1]}", lg) for n, lg in enumerate(names)]
    model = L.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == names and model.weights.shape == (L.CELLS, 300)
    got = {r["doc_id"]: r for r in L.predict(documents(spark, [t for _, t, _ in rows]), model).collect()}
    assert all(got[n]["lang_pred"] == lg for n, _, lg in rows)
    sym = [0, *map(ord, word(7)), 0, *map(ord, word(7)[::-1]), 0]
    sums = sum(model.weights[c[c >= 0]].astype(np.float64).sum(0) for c in L.cells(np.array(sym, np.uint32), np.array([0, len(sym)])))
    p = np.exp((sums - sums.max()) / np.sqrt(len(sym) * len(L.ORDERS)))
    assert abs(got[7]["score"] - p[7] / p.sum()) < 1e-6


def test_null_keys_and_repeated_rows(spark):
    """Each row is judged by its own text, and all rows of a label count in training."""
    rows = [(1, "abc abd", "en"), (1, "abc abd", "en"), (None, "xyz xyw", "de"), (2, "xyz", "de"), (3, None, "en"), (4, "123", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in L.predict(frame, L.train(frame)).collect())
    assert got == [(0, "de"), (1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und")]
