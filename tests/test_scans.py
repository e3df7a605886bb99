"""Ordered rows with caps, numbering without a global window, exact medians, facts by question, the text critic."""

import random
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens import schema as S
from budgetlens.operators import coverage, metrics, text_critic
from budgetlens.plans import queries
from budgetlens.sources import capped, construct, files


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_follow_the_key_and_no_task_sees_all_rows(spark):
    keys = random.Random(3).sample(range(100_000), 5000)
    df = spark.createDataFrame([(k, k % 7) for k in keys], "key int, size int").repartition(7)
    told = construct.numbered(df, "key")
    assert "SinglePartition" not in plan_of(told)
    assert {r["key"]: r["n"] for r in told.collect()} == {k: i + 1 for i, k in enumerate(sorted(keys))}
    before, want = 0, {}
    for k in sorted(keys):
        want[k], before = before, before + k % 7
    assert {r["key"]: r["b"] for r in construct.numbered(df, "key", "b", "size").collect()} == want
    assert construct.numbered(df.limit(0), "key").count() == 0


@pytest.mark.parametrize("many", [3, 50, 10_000])
def test_medians_equal_sorting(spark, many):
    rng = random.Random(many)
    rows = [(g, rng.choice([rng.gauss(0, 1), rng.lognormvariate(0, 9), 1.5, -0.0, rng.randint(-3, 3) * 1e300])) for g in "abc" for _ in range(300)]
    rows += [("one", 7.0), (None, 2.0), (None, 4.0), ("same", 3.0), ("same", 3.0), ("a", None), ("a", float("nan"))] + [("twin", float(i % 2)) for i in range(80)]
    want = {}
    for g, v in rows:
        if v is not None and v == v:
            want.setdefault(g, []).append(v)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: r["median"] for r in metrics.medians(df, "v", "g", many=many).collect()}
    assert got == {g: pytest.approx(statistics.median(v), rel=1e-12) for g, v in want.items()}
    every = [v for vs in want.values() for v in vs]
    assert metrics.medians(df, "v", many=many).collect()[0]["median"] == pytest.approx(statistics.median(every), rel=1e-12)
    assert metrics.medians(df.limit(0), "v", "g", many=many).count() == 0


def short_rows(spark, n):
    def row(i):
        words = [] if i % 7 == 0 else [f"w{i}", "b", "c", f"d{i}"]
        spans = [{"start_token": [1], "end_token": [4]}] if i % 5 else []
        return (i, {"tokens": {"token": words}}, {"text": f"question {i}"}), {"short_answers": spans, "long_answer": []}

    data = [(*row(i)[0], row(i)[1]) for i in range(1, n + 1)]
    return spark.createDataFrame(data, T.StructType([T.StructField("n", T.LongType()), *S.SHORT_FORM_ROW.fields]))


def stored(rows, path, schema):
    rows.repartitionByRange(4, "n").sortWithinPartitions("n").select(*schema.names).write.option("maxRecordsPerFile", 20).parquet(path)


def test_ordered_rows_number_rows_and_prune_row_groups(spark, tmp_path):
    path = str(tmp_path / "rows")
    stored(short_rows(spark, 150), path, S.SHORT_FORM_ROW)
    rows = capped.ordered_rows(spark, path, S.SHORT_FORM_ROW)
    got = rows.select("n", "question.text").collect()
    assert sorted((r["n"], r["text"]) for r in got) == [(i, f"question {i}") for i in range(1, 151)]
    some = capped.ordered_rows(spark, path, S.SHORT_FORM_ROW, 31, 45)
    assert sorted(r["n"] for r in some.filter("question.text is not null").collect()) == list(range(31, 46))
    assert some.filter("n <= 40").count() == 10 and some.count() == 15 and rows.count() == 150
    parts = capped.OrderedReader(path, rows.schema, 1, 25).partitions()
    assert len(parts) == 2 and all(p.before < 25 for p in parts) and len(capped.OrderedReader(path, rows.schema, 1, 1 << 62).partitions()) == 8
    assert capped.ordered_rows(spark, path, S.SHORT_FORM_ROW, 77, 77).count() == 1 and capped.ordered_rows(spark, path, S.SHORT_FORM_ROW, 1000).count() == 0


@pytest.mark.parametrize(("most_rows", "most_docs"), [(60, 1000), (150, 25), (150, 1000), (10, 1)])
def test_scans_end_at_their_caps(spark, tmp_path, most_rows, most_docs):
    path = str(tmp_path / "rows")
    stored(short_rows(spark, 150), path, S.SHORT_FORM_ROW)
    docs, asked = capped.short_form(spark, path, most_rows=most_rows, most_docs=most_docs, first=8)
    want = [i for i in range(1, most_rows + 1) if i % 7 and i % 5][:most_docs]
    assert sorted(r["doc_id"] for r in docs.collect()) == [f"doc_{i:06d}" for i in want] and asked.count() == len(want)


def test_a_prefix_reads_no_more_than_it_needs(spark, tmp_path):
    path = str(tmp_path / "rows")
    stored(short_rows(spark, 150), path, S.SHORT_FORM_ROW)
    kept = lambda df: df.filter("n % 2 = 0")
    assert capped.prefix(spark, path, S.SHORT_FORM_ROW, kept, 150, 10, first=8).count() == 32
    assert capped.prefix(spark, path, S.SHORT_FORM_ROW, kept, 150, 1000, first=8).count() == 150


def test_facts_by_question_are_read_without_a_shuffle(spark, tmp_path):
    runs = spark.createDataFrame([(m, f"q{q}", d, d + 1) for m in ("dense", "hybrid") for q in range(20) for d in range(5)], "method string, qid string, doc_id bigint, rank int")
    files.write_facts({"runs": runs}, str(tmp_path), buckets=4)
    held = files.read_facts(spark, str(tmp_path))["runs"]
    assert sorted(held.collect()) == sorted(runs.collect())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "Exchange" not in plan_of(held.groupBy("qid").count()) and "Exchange hashpartitioning" in plan_of(runs.groupBy("qid").count())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files.forget(held)
    gold = spark.createDataFrame([(f"q{q}", 1) for q in range(20)], "qid string, doc_id bigint")
    rows = (("a", "dense", 1), ("b", "hybrid", 5))
    plain = coverage.coverage(runs, gold, S.strategies(spark, rows))
    grid = tuple((f"{m}@{k}", m, k) for m in ("dense", "hybrid") for k in (1, 5))
    assert sorted(coverage.chosen(coverage.coverage(runs, gold, S.strategies(spark, grid)).drop("level", "name"), rows).select(*plain.columns).collect()) == sorted(plain.collect())


def samples(spark, n=240):
    """Documents that hold the question's words in order are sufficient; the same words in disorder are not."""
    rng, out = random.Random(5), []
    for i in range(n):
        words = [f"t{rng.randrange(40)}" for _ in range(5)]
        good = i % 2
        said = words if good else sorted(words, key=lambda _: rng.random())[::-1]
        out.append((f"q{i}", " ".join(words), ("dense", "hybrid", "rerank")[i % 3], i % 3 + 1, 3, " ".join([f"x{rng.randrange(40)}", *said, f"x{rng.randrange(40)}"]), good, []))
    return spark.createDataFrame(out, "qid string, question string, phase string, level int, k int, docs string, label int, ranked array<bigint>")


def test_gradients_equal_a_plain_model():
    rng = np.random.default_rng(2)
    cells = pa.array([[1, 5, 9], [], [5], [2, 9]], pa.list_(pa.int32()))
    weights, labels = rng.normal(size=text_critic.CELLS), np.array([1.0, 0.0, 0.0, 1.0])
    want = np.zeros(text_critic.CELLS)
    for c, y in zip(cells.to_pylist(), labels):
        p = 1 / (1 + np.exp(-(weights[c].sum() + weights[-1])))
        for i in [*c, text_critic.CELLS - 1]:
            want[i] += p - y
    assert np.allclose(text_critic.gradient(weights, cells, labels), want)
    assert np.allclose(text_critic.gradient(weights, cells[1:3], labels[1:3]) + text_critic.gradient(weights, cells[:1], labels[:1]) + text_critic.gradient(weights, cells[3:], labels[3:]), want)


def test_a_step_over_tasks_is_that_of_one_task_and_training_learns_word_order(spark, tmp_path):
    rows = samples(spark)
    weights = np.random.default_rng(1).normal(size=text_critic.CELLS) / 10
    made = text_critic.features(rows).select("cells", "label")
    many, n = text_critic._gradients(made.repartition(5), weights)
    one, _ = text_critic._gradients(made.coalesce(1), weights)
    assert n == 240 and np.allclose(many, one)
    model = text_critic.train(rows.filter("crc32(qid) % 3 > 0"), rows.filter("crc32(qid) % 3 = 0"), epochs=2, batches=3, rate=0.2)
    assert model.f1 > 0.8 and model.epoch in (0, 1)
    model.write(spark, str(tmp_path / "critic"))
    again = text_critic.Model.read(spark, str(tmp_path / "critic"))
    assert np.array_equal(again.weights, model.weights) and (again.f1, again.epoch) == (model.f1, model.epoch)


def test_stage_times_tell_what_was_observed(spark, data):
    told = {r["stage"]: r for r in queries.QUERIES["stage_latency"](spark, data).collect()}
    assert set(told) == {"dense", "bm25", "hybrid", "rerank"} and all(r["ms"] > 0 and 0 < r["n_answered"] <= r["n_questions"] and r["n_rows"] >= r["n_answered"] for r in told.values())
