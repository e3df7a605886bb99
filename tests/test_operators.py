"""Operators on hand-made rows, and against a plain model of the decisions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from budgetlens import schema as S
from budgetlens.functions import text as X
from budgetlens.operators import coverage, critic, dense, fusion, lexical, matching, metrics, policy, sweep
from budgetlens.sources import construct, report


def column(spark, expr, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokens_drop_stop_words_and_single_characters(spark):
    assert column(spark, X.tokens, "The Cat's re-run of 1 x2, a", "", None) == [["cat's", "re-run", "x2"], [], None]


def test_first_words_collapse_white_space(spark):
    assert column(spark, lambda c: X.first_words(c, 2), "  a\t b  c", "", "one") == ["a b", "", "one"]


def test_label_parse(spark):
    answers = ("easy", "Medium.", "  HARD\n", "uneasy", "", "hard or easy", None)
    assert column(spark, X.label_or_easy, *answers) == ["easy", "medium", "hard", "easy", "easy", "hard", "easy"]


def test_rule_labels(spark):
    long = " ".join(["word"] * 18)
    questions = ("Who is it", "Compare both", long, "Did Ann Lee meet the man for whom Bob Ray once wrote it", "for them")
    assert column(spark, policy.rule_label, *questions) == ["easy", "medium", "hard", "medium", "easy"]


def test_dense_topk_equals_brute_force_with_ties_and_nulls(spark):
    rng = np.random.default_rng(1)
    docs = [(i, [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(60)] + [(60, None)]
    asked = [(f"q{i}", [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(5)]
    got = dense.dense_topk(spark.createDataFrame(asked, "qid string, vec array<double>"), spark.createDataFrame(docs, "doc_id bigint, vec array<double>").repartition(3), 7).collect()
    want = {(q, r + 1): d for q, v in asked for r, (_, d) in enumerate(sorted((-float(np.dot(v, w)), d) for d, w in docs if w)[:7])}
    assert {(r["qid"], r["rank"]): r["doc_id"] for r in got} == want


def test_dense_topk_without_queries(spark):
    none = spark.createDataFrame([], "qid string, vec array<double>")
    assert dense.dense_topk(none, spark.createDataFrame([(1, [1.0])], "doc_id bigint, vec array<double>"), 3).count() == 0


def test_bm25_equals_a_plain_model(spark, tmp_path):
    import math
    from collections import Counter

    docs = [(1, "apple pie apple"), (2, "apple tart"), (3, ""), (4, "pear pie crust"), (5, "apple apple"), (6, None)]
    words = {d: (t or "").split() for d, t in docs}
    n, avgdl = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(t for w in words.values() for t in set(w))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    want = {d: sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avgdl)) for t in ("apple", "apple", "pie")) for d, w in words.items()}
    index = lexical.build(spark.createDataFrame(docs, "doc_id bigint, text string"))
    index.write(str(tmp_path / "index"))
    index = lexical.Index.read(spark, str(tmp_path / "index"))
    got = {r["doc_id"]: r["score"] / 1e9 for r in lexical.bm25_topk(spark.createDataFrame([("q", "apple Apple pie")], "qid string, question string"), index, 10).collect()}
    assert got == pytest.approx({d: v for d, v in want.items() if v > 0}, abs=1e-8)


def test_rrf_goes_by_rank_not_by_score(spark):
    lists = [spark.createDataFrame([("q", d, r) for r, d in enumerate(ids, 1)], "qid string, doc_id bigint, rank int") for ids in ((7, 8, 9), (9, 8))]
    got = [(r["doc_id"], round(r["score"], 9)) for r in fusion.rrf(lists).orderBy("rank").collect()]
    assert got == [(9, round(1 / 63 + 1 / 61, 9)), (8, round(2 / 62, 9)), (7, round(1 / 61, 9))]


def test_rerank_breaks_ties_by_the_pool(spark):
    pool = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3)], "qid string, doc_id bigint, rank int")
    docs = spark.createDataFrame([(1, "none"), (2, "nothing"), (3, "Red Fox runs")], "doc_id bigint, text string")
    got = fusion.rerank(pool, spark.createDataFrame([("q", "red fox")], "qid string, question string"), docs).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [3, 1, 2]


def test_containing_passages(spark):
    docs = spark.createDataFrame([(1, "a long text"), (2, None), (3, "text")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "text"), (2, "long"), (3, "")], "item_id bigint, text string")
    assert sorted(map(tuple, matching.containing(docs, items).collect())) == [(1, 1), (1, 3), (2, 1)]


def _random_world(seed):
    rng = random.Random(seed)
    qids = [f"q{i}" for i in range(25)]
    gold = {q: set(rng.sample(range(30), rng.choice((1, 1, 2, 3)))) for q in qids}
    runs = {(m, q): rng.sample(range(30), rng.choice((0, 4, 20, 20))) for m in ("dense", "hybrid", "rerank") for q in qids}
    return qids, gold, runs


def _frames(spark, gold, runs):
    rows = [(m, q, d, r) for (m, q), ids in runs.items() for r, d in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "method string, qid string, doc_id bigint, rank int"), spark.createDataFrame([(q, d) for q, g in gold.items() for d in g], "qid string, doc_id bigint")


@pytest.mark.parametrize("seed", [1, 2])
def test_decisions_equal_a_plain_model(spark, seed):
    qids, gold, lists = _random_world(seed)
    runs, qrels = _frames(spark, gold, lists)
    found = lambda q, m, k: len(set(lists[m, q][:k]) & gold[q]) / len(gold[q])
    cov = coverage.coverage(runs, qrels, S.strategies(spark, S.STRATEGIES7)).cache()
    assert {(r["qid"], r["name"]): r["cov"] for r in cov.collect()} == {(q, n): found(q, m, k) for q in qids for n, m, k in S.STRATEGIES7}

    def pick(q):
        full = [n for n, m, k in S.STRATEGIES7 if found(q, m, k) == 1]
        return full[0] if full else max(S.STRATEGIES7, key=lambda s: found(q, s[1], s[2]))[0]

    assert {r["qid"]: r["name"] for r in policy.oracle_pick(cov).collect()} == {q: pick(q) for q in qids}

    def level(q):
        ranks = [min([lists[m, q].index(d) + 1 for m in ("dense", "hybrid", "rerank") if d in lists[m, q]], default=99) for d in gold[q]]
        return "easy" if max(ranks) <= 3 else "medium" if max(ranks) <= 10 else "hard"

    assert {r["qid"]: r["difficulty"] for r in coverage.difficulty(runs, qrels).collect()} == {q: level(q) for q in qids}
    ladder = coverage.coverage(runs, qrels, S.strategies(spark, S.LADDER_A))
    stop = lambda q: next((n for n, m, k in S.LADDER_A if found(q, m, k) == 1), "rerank@20")
    assert {r["qid"]: r["name"] for r in policy.ladder_stop(ladder).collect()} == {q: stop(q) for q in qids}


def test_ladder_prices_follow_the_method_that_stops(spark):
    """Stop counts of published experiments and the documents and times that follow from them."""
    counts = {"A": ((684, 146, 46, 33, 91), 5.392, 66.9), "B": ((874, 30, 0, 96), None, None)}
    stops, docs, ms = counts["A"]
    rows = [(f"q{i}", lv + 1, *S.LADDER_A[lv], 1.0, True) for lv, n in enumerate(stops) for i in range(n)]
    frame = spark.createDataFrame(rows, 'qid string, level int, name string, method string, k int, cov double, `full` boolean')
    got = policy.ladder_summary(frame, S.stage_latencies(spark)).first()
    assert got["mean_docs"] == pytest.approx(docs) and round(got["mean_ms"], 1) == ms


def test_critic_stop_charges_the_critic_at_each_stage(spark):
    for counts, want in (((532, 263, 205), 94.5147), ((533, 247, 220), 96.4297)):
        rows = [(m, k, lv + 1) for lv, ((_, m, k), n) in enumerate(zip(S.LADDER_3, counts)) for _ in range(n)]
        frame = spark.createDataFrame(rows, "method string, k int, level int").join(S.stage_latencies(spark), "method")
        assert frame.agg(F.avg(F.col("ms") + 4.711116 * F.col("level"))).first()[0] == pytest.approx(want, abs=1e-3)


def test_selection_and_pareto_front(spark):
    rows = [(1, "d0.95/h0.65", 0.9405, 7.011), (2, "d0.95/h0.75", 0.943, 7.326), (3, "t=0.90", 0.9415, 7.664), (4, "t=0.95", 0.946, 8.286), (5, "cheap", 0.93, 1.0)]
    table = spark.createDataFrame(rows, "config_ord int, config string, recall double, docs double")
    assert sweep.select(table).first()["config"] == "d0.95/h0.65"
    assert {r["config"] for r in sweep.pareto(table).collect()} == {"d0.95/h0.65", "d0.95/h0.75", "t=0.95"}
    assert [r["config"] for r in sweep.cheapest(table, 2).collect()] == ["d0.95/h0.65", "d0.95/h0.75"]
    with pytest.raises(ValueError):
        sweep.select(table, 0.99, strict=True)


def test_confusion_counts_the_threshold_as_positive(spark):
    rows = [("dense", 0.5, 1), ("dense", 0.4, 1), ("dense", 0.9, 0), ("hybrid", 0.1, 0)]
    got = {r["phase"]: r for r in metrics.confusion(spark.createDataFrame(rows, "phase string, p double, label int")).collect()}
    assert (got["dense"]["tp"], got["dense"]["fn"], got["dense"]["fp"]) == (1, 1, 1) and got["hybrid"]["f1"] == 0


def test_samples_keep_the_order_of_ranks_and_empty_lists(spark):
    runs, qrels = _frames(spark, {"q": {1}, "z": {5}}, {("dense", "q"): [3, 1, 2], ("hybrid", "q"): [1]})
    docs = spark.createDataFrame([(1, "one  x"), (2, "two"), (3, "three y")], "doc_id bigint, text string")
    asked = spark.createDataFrame([("q", "?"), ("z", "?")], "qid string, question string")
    cov = coverage.coverage(runs, qrels, S.strategies(spark, S.LADDER_3))
    got = {(r["qid"], r["phase"]): r for r in critic.samples(asked, runs, docs, cov).collect()}
    assert got["q", "dense"]["docs"] == "three y one x two" and got["q", "dense"]["ranked"] == [3, 1, 2] and got["q", "dense"]["label"] == 1
    assert got["z", "rerank"]["docs"] == "" and got["z", "rerank"]["label"] == 0


def test_short_form_rows(spark):
    tokens = ["Paris", "is", "the", "capital", "of", "France"]

    def row(n, words, question, shorts, long):
        return (n, ((words,),), (question,), ([([a], [b]) for a, b in shorts], [long]))

    rows = [row(1, tokens, " where ", [(-1, -1), (0, 1)], (0, 3)), row(2, tokens, "what", [(-1, -1)], (3, 6)), row(3, [], "x", [], (0, 1)), row(4, tokens, "", [(0, 1)], (0, 1)), row(5, tokens, "none", [], (-1, -1))]
    from pyspark.sql import types as T

    frame = spark.createDataFrame(rows, T.StructType([T.StructField("n", T.LongType()), *S.SHORT_FORM_ROW.fields]))
    docs, questions = construct.short_form(frame, "n", tokens=3)
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == {"doc_000001": "Paris is the", "doc_000002": "Paris is the"}
    assert {(r["qid"], r["question"], r["answer"], *r["gold_docs"]) for r in questions.collect()} == {("nq_000001", " where ", "Paris", "doc_000001"), ("nq_000002", "what", "capital of France", "doc_000002")}
    assert [r["doc_id"] for r in construct.short_form(frame, "n", most_docs=1)[0].collect()] == ["doc_000001"]
    assert [r["qid"] for r in construct.short_form(frame, "n", most_rows=1)[1].collect()] == ["nq_000001"]


def test_multi_hop_rows(spark):
    from pyspark.sql import types as T

    rows = [
        (1, "q1", "a1", "bridge", (["T", "U"], [0, 1, 2]), (["T", "V", "U"], [["a", "b"], ["c"]])),
        (2, "q2", "a2", "comparison", (["W"], [0]), (["X"], [["d"]])),
        (3, "q3", "a3", "bridge", (["T"], [0]), (["T"], [["e"]])),
    ]
    frame = spark.createDataFrame(rows, T.StructType([T.StructField("n", T.LongType()), *S.MULTI_HOP_ROW.fields]))
    docs, questions, qrels = construct.multi_hop(frame, "n")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == {"hp_000000": "a b", "hp_000001": "c", "hp_000002": "", "hp_000003": "d", "hp_000004": "e"}
    assert {(r["qid"], r["n_supporting"], r["n_sent"]) for r in questions.collect()} == {("hotpot_000001", 2, 3), ("hotpot_000003", 1, 1)}
    assert {tuple(r) for r in qrels.collect()} == {("hotpot_000001", "hp_000000"), ("hotpot_000001", "hp_000002"), ("hotpot_000003", "hp_000004")}


def test_knowledge_base_and_splits(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    qrels = spark.createDataFrame([("a", 1), ("a", 2), ("b", 99)], "qid string, doc_id bigint")
    kb = construct.knowledge_base(docs, qrels, 10)
    assert kb.count() == 10 and {r["doc_id"] for r in kb.filter("is_gold").collect()} == {1, 2}
    assert construct.knowledge_base(docs, qrels, 1).count() == 2
    asked = spark.createDataFrame([("a",), ("b",)], "qid string")
    assert [r["qid"] for r in construct.answerable(asked, qrels, kb).collect()] == ["a"]
    parts = construct.splits(docs.select(F.col("doc_id").alias("qid")), (("test", 5), ("train", 20))).cache()
    assert {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()} == {"test": 5, "train": 20}
    assert sweep.leakage(parts.filter("split = 'test'"), parts.filter("split = 'train'")).first()["n_leaked"] == 0
    assert construct.same_rows(docs, docs.orderBy(F.desc("doc_id"))) and not construct.same_rows(docs, docs.limit(49))


def test_hash_embedder_and_pluggable_models(spark):
    rows = spark.createDataFrame([("q", "x"), ("r", None)], "qid string, question string")
    vectors = dense.embedded(rows, "question", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert {r["qid"]: r["vec"] for r in vectors.collect()} == {"q": [1.0, 1.0], "r": [0.0, 1.0]}
    told = policy.model_label(rows, lambda: lambda prompts: prompts.map(lambda p: "Hard!" if p.endswith("x") else "?"))
    assert {r["qid"]: (r["label"], r["parsed"]) for r in told.collect()} == {"q": ("hard", True), "r": ("easy", False)}
    score = fusion.scored_by(lambda: lambda q, t: q.str.len() * 1.0 + t.str.len())
    assert rows.filter("qid = 'q'").select(score("question", "qid").alias("s")).first()["s"] == 2.0


def test_markdown(spark):
    table = spark.createDataFrame([("a", 0.5), ("b", None)], "name string, share double")
    assert report.markdown(table, {"share": ".1%"}, ("name",)) == "| name | share |\n|---|---|\n| a | 50.0% |\n| b | - |\n"


def test_buckets_and_softmax(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (3, 1.0, 3.0), (None, 2.0, 0.0)], "n int, a double, b double")
    got = rows.select(X.sentence_bucket(F.col("n")).alias("s"), X.positive_probability(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r["s"] for r in got] == ["2", "3+", None]
    assert [r["p"] for r in got] == pytest.approx([0.5, 1 / (1 + np.exp(-2)), 1 / (1 + np.exp(2))])


def test_critic_model_and_vectors_are_kept(spark, tmp_path):
    from budgetlens.sources import files

    rows = spark.createDataFrame([(f"q{i}", "red fox", "dense", 1, 3, "red fox" if i % 2 else "blue hen", i % 2, [1]) for i in range(12)], "qid string, question string, phase string, level int, k int, docs string, label int, ranked array<int>")
    model, f1 = critic.train(rows, rows)
    critic.save(model, str(tmp_path / "model"))
    again = {r["qid"]: r["p"] for r in critic.scored(critic.load(str(tmp_path / "model")), rows).collect()}
    assert f1 == 1.0 and again == {r["qid"]: r["p"] for r in critic.scored(model, rows).collect()}
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id bigint, vec array<double>")
    files.write_vectors(vectors, str(tmp_path / "vectors"))
    assert construct.same_rows(files.read_vectors(spark, str(tmp_path / "vectors")).selectExpr("doc_id", "vec[0] AS x"), vectors.selectExpr("doc_id", "vec[0] AS x"))


def test_measured_latencies(spark):
    from budgetlens.plans.latency import measured

    got = metrics.latency_summary(measured(spark, {"a": lambda: spark.range(3), "b": lambda: spark.range(1)}, 2), "ms", "stage").collect()
    assert {(r["stage"], r["n"]) for r in got} == {("a", 2), ("b", 2)} and all(r["mean"] > 0 for r in got)
