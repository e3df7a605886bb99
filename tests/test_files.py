import json

from budgetlens.operators import lexical
from budgetlens.sources import files, report
from budgetlens.streaming import scoring


def test_dataset_round_trip(spark, tmp_path):
    path = tmp_path / "set.json"
    path.write_text(json.dumps({"name": "s", "kb": {"d1": "one", "d2": "two"}, "questions": [{"qid": "q", "question": "?", "answer": "a", "gold_docs": ["d1", "d2"]}]}))
    docs, questions, qrels = files.read_dataset(spark, str(path))
    assert {(r["doc_id"], r["text"]) for r in docs.collect()} == {("d1", "one"), ("d2", "two")}
    assert questions.first()["n_sent"] is None and qrels.count() == 2


def test_runs_prefer_a_variant(spark, tmp_path):
    rows = [("dense", "base", "q", "d1", 1, 1.0), ("rerank", "base", "q", "d1", 1, 1.0), ("rerank", "large", "q", "d2", 1, 1.0), ("rerank", "large", "q", "d1", 2, 0.5)]
    files.write_runs(spark.createDataFrame(rows, "method string, variant string, qid string, doc_id string, rank int, score double"), str(tmp_path / "runs"))
    kept = files.preferred(files.read_runs(spark, str(tmp_path / "runs")), ("large", "base"))
    assert {(r["method"], r["variant"]) for r in kept.collect()} == {("dense", "base"), ("rerank", "large")}
    assert {r["method"]: r["ranked"] for r in files.ranked_lists(kept, "method").collect()} == {"dense": ["d1"], "rerank": ["d2", "d1"]}


def test_run_files_and_maps(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"ks": [1], "results": [{"qid": "q", "gold": ["a"], "ranked": ["b", "a"]}]}))
    assert {(r["doc_id"], r["rank"]) for r in files.read_run_file(spark, str(tmp_path / "run.json"), "dense").collect()} == {("b", 1), ("a", 2)}
    (tmp_path / "all.json").write_text(json.dumps({"dense": {"q": ["a"]}, "hybrid": {"q": ["b", "a"]}, "rerank": {}}))
    assert files.read_all_runs(spark, str(tmp_path / "all.json")).count() == 3
    (tmp_path / "gold.json").write_text(json.dumps({"q": ["a", "b"]}))
    gold = files.read_gold_map(spark, str(tmp_path / "gold.json"))
    files.write_gold(gold, str(tmp_path / "gold"))
    assert {tuple(r) for r in files.read_gold(spark, str(tmp_path / "gold")).collect()} == {("q", "a"), ("q", "b")}
    (tmp_path / "preds.json").write_text(json.dumps({"q": "hard"}))
    assert files.read_predictions(spark, str(tmp_path / "preds.json")).first()["label"] == "hard"


def test_samples_round_trip(spark, tmp_path):
    rows = [("val", "q", "?", "dense", 3, "text", 1, ["a"]), ("test", "r", "?", "dense", 3, "", 0, [])]
    files.write_samples(spark.createDataFrame(rows, "split string, qid string, question string, phase string, k int, docs string, label int, ranked array<string>"), str(tmp_path / "samples"))
    assert files.read_samples(spark, str(tmp_path / "samples"), "val").first()["ranked"] == ["a"]


def test_defaults_and_reports(spark, tmp_path):
    assert files.with_default(None, "critic_ms", 4.7, spark).first()["critic_ms"] == 4.7
    held = spark.createDataFrame([(5.1,)], "critic_ms double")
    assert files.with_default(held, "critic_ms", 4.7, spark).first()["critic_ms"] == 5.1
    report.write_json(held, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["critic_ms"] == 5.1


def test_streamed_questions_are_ranked_as_batches(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox"), (3, "green hen")], "doc_id bigint, text string")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"qid": "q", "question": "red hen"}\n')
    stream = spark.readStream.schema("qid string, question string").json(str(tmp_path / "in"))
    search = scoring.bm25_stream(stream, lexical.build(docs), 5, str(tmp_path / "out"), str(tmp_path / "check"))
    search.awaitTermination()
    assert {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 3}


def test_questions_by_id_keep_the_last(spark):
    rows = [("q", 1, "old"), ("q", 3, "new"), ("q", 2, "mid"), ("r", 1, "only")]
    got = files.by_qid(spark.createDataFrame(rows, "qid string, place int, question string"), "place")
    assert {tuple(r) for r in got.collect()} == {("q", 3, "new"), ("r", 1, "only")}


def test_dataset_file_is_written_and_read(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "one"), ("d2", "two")], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "?", "a", ["d1", "d2"])], "qid string, question string, answer string, gold_docs array<string>")
    files.write_dataset("s", docs, asked, str(tmp_path / "set"))
    back, questions, qrels = files.read_dataset(spark, str(tmp_path / "set"))
    assert {tuple(r) for r in back.collect()} == {("s", "d1", "one"), ("s", "d2", "two")}
    assert questions.first()["question"] == "?" and qrels.count() == 2


def test_curve_is_an_svg_of_all_points(spark, tmp_path):
    table = spark.createDataFrame([("a<b", 3.0, 0.5), ("c", 5.0, 0.75), ("d", 9.0, 0.8)], "config string, docs double, recall double")
    report.curve(table, str(tmp_path / "curve.svg"))
    text = (tmp_path / "curve.svg").read_text()
    assert text.count("<circle") == 3 and "a&lt;b" in text and text.startswith("<svg")


def test_command_line_writes_a_phase_and_a_query(spark, data, tmp_path):
    from budgetlens.__main__ import main

    main(["retrieve", "--phase", "bm25", "--tables", data, "--k", "5", "--out", str(tmp_path / "runs")], spark)
    runs = files.read_runs(spark, str(tmp_path / "runs"))
    assert runs.filter("rank > 5").count() == 0 and {r["method"] for r in runs.select("method").distinct().collect()} == {"bm25"}
    main(["query", "--name", "split_assign", "--tables", data, "--out", str(tmp_path / "split")], spark)
    assert spark.read.parquet(str(tmp_path / "split")).count() > 0


def test_latency_of_each_question(spark):
    from budgetlens.plans import latency

    asked = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "qid string, question string")
    rows = latency.per_question(asked, {"one": lambda q: q, "two": lambda q: q.limit(1)}, most=2).collect()
    assert sorted((r["stage"], r["qid"]) for r in rows) == [("one", "a"), ("one", "b"), ("two", "a"), ("two", "b")] and all(r["ms"] > 0 for r in rows)


def test_scans_end_at_their_caps(spark):
    from budgetlens.sources import construct

    tokens = [f"w{i}" for i in range(1200)]
    spans = {"short_answers": [{"start_token": [0], "end_token": [3]}], "long_answer": []}
    rows = [{"n": n, "document": {"tokens": {"token": tokens if n != 2 else []}}, "question": {"text": "why"}, "annotations": spans} for n in range(1, 8)]
    from budgetlens import schema as S
    from pyspark.sql import types as T

    raw = spark.createDataFrame(rows, T.StructType([T.StructField("n", T.LongType()), *S.SHORT_FORM_ROW.fields]))
    docs, questions = construct.short_form(raw, "n", most_rows=6, most_docs=3)
    assert sorted(r["doc_id"] for r in docs.collect()) == ["doc_000001", "doc_000003", "doc_000004"] and questions.count() == 3
    assert construct.short_form(raw, "n", most_rows=3)[0].count() == 2
