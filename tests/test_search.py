"""Search that skips what cannot matter, stored and grown indexes, and the ladder that runs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from budgetlens.operators import blockmax, cells, critic, dense, fusion, lexical, matching, staged
from budgetlens.plans import fixtures
from budgetlens.plans.fixtures import Fixtures
from budgetlens.sources import files


def corpus(spark, n=300, seed=1, words=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60))) for _ in range(n)] + ["", None]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def asked(spark, n=12, seed=2, words=120):
    rng = random.Random(seed)
    rows = [(f"q{i}", " ".join(f"w{int(rng.random() ** 2 * words)}" for _ in range(rng.randint(1, 8)))) for i in range(n)]
    return spark.createDataFrame([*rows, ("none", "zzz"), ("null", None)], "qid string, question string")


def rows(df):
    return sorted(tuple(r) for r in df.select("qid", "doc_id", "rank", "score").collect())


@pytest.mark.parametrize(("k", "block", "levels"), [(3, 4, 8), (20, 128, 32), (1000, 4, 4)])
def test_block_max_finds_what_the_full_search_finds(spark, monkeypatch, k, block, levels):
    monkeypatch.setattr(blockmax, "BLOCK", block)
    monkeypatch.setattr(blockmax, "LEVELS", levels)
    index = lexical.build(corpus(spark), keep=True)
    top, reads = blockmax.pruned_topk(asked(spark), blockmax.build(index), k)
    assert rows(top) == rows(lexical.bm25_topk(asked(spark), index, k))
    told = reads.collect()
    assert len(told) == 12 and all(r["n_read"] + r["n_looked"] <= r["n_all"] for r in told)
    if k == 3:
        assert sum(r["n_read"] + r["n_looked"] for r in told) < 0.8 * sum(r["n_all"] for r in told)


def test_block_max_without_documents_and_with_weights_below_zero(spark, tmp_path):
    # a term in every document has a negative idf before its floor; a corpus of one such term keeps it
    docs = spark.createDataFrame([(i, "common common other" if i % 2 else "common") for i in range(40)], "doc_id bigint, text string")
    queries = spark.createDataFrame([("a", "common"), ("b", "common other")], "qid string, question string")
    index = lexical.build(docs)
    made = blockmax.build(index)
    made.write(str(tmp_path / "blocks"))
    assert rows(blockmax.pruned_topk(queries, blockmax.BlockIndex.read(spark, str(tmp_path / "blocks")), 5)[0]) == rows(lexical.bm25_topk(queries, index, 5))
    empty = lexical.build(docs.limit(0))
    assert rows(blockmax.pruned_topk(queries, blockmax.build(empty), 5)[0]) == []


def test_cells_find_what_the_full_search_finds_and_skip_far_ones(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(8, 6)) * 4
    vectors = [(i, (middles[i % 8] + rng.normal(size=6) * 0.2).tolist(), float(rng.uniform(0.5, 2)) if i % 5 else None) for i in range(400)]
    docs = spark.createDataFrame(vectors, "doc_id bigint, vec array<double>, norm double")
    queries = spark.createDataFrame([(f"q{i}", (middles[i % 8] + rng.normal(size=6)).tolist()) for i in range(10)] + [("no", None)], "qid string, vec array<double>")
    for frame in (docs, docs.drop("norm")):
        index = cells.build(frame, cells=16)
        for k, positive in ((5, False), (40, True), (1000, False)):
            top, reads = cells.pruned_topk(queries, index, k, positive)
            full = dense.dense_topk(queries, frame, k, positive)
            ids = lambda df: sorted((r["qid"], r["rank"], r["doc_id"]) for r in df.collect())
            assert ids(top) == ids(full)
            if k == 5:
                told = reads.agg(F.sum("n_scored"), F.sum("n_all")).first()
                assert told[0] < 0.6 * told[1]


def test_an_index_that_grows_equals_a_full_build(spark, tmp_path):
    docs, path = corpus(spark, 90), str(tmp_path / "index")
    lexical.build(docs.filter("doc_id % 3 = 0")).write(path)
    lexical.Index.append(path, docs.filter("doc_id % 3 = 1"))
    grown = lexical.Index.append(path, docs.filter("doc_id % 3 = 2"))
    full = lexical.build(docs)
    assert (grown.n, grown.words) == (full.n, full.words)
    near = lambda index: {r["term"]: (r["df"], round(r["idf"], 9)) for r in index.idf.collect()}
    assert near(grown) == near(full)
    assert rows(lexical.bm25_topk(asked(spark), grown, 10)) == rows(lexical.bm25_topk(asked(spark), full, 10))
    # a batch whose size was never written is not seen
    spark.createDataFrame([("w1", 999, 5, 5)], "term string, doc_id bigint, tf bigint, dl bigint").write.parquet(f"{path}/postings/version=3")
    assert rows(lexical.bm25_topk(asked(spark), lexical.Index.read(spark, path), 10)) == rows(lexical.bm25_topk(asked(spark), full, 10))


def test_later_stages_search_for_unsatisfied_questions_only(spark):
    questions = spark.createDataFrame([(f"q{i}", "some words") for i in range(6)], "qid string, question string")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id bigint, text string")
    seen = []

    def search(name, k):
        def run(todo):
            seen.append((name, sorted(r["qid"] for r in todo.collect())))
            return todo.select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")).select("qid", F.col("rank").cast("bigint").alias("doc_id"), "rank")

        return run

    score = lambda df: df.withColumn("p", F.when(F.col("qid") < F.concat(F.lit("q"), (F.col("level") * 2).cast("string")), 0.9))
    stages = [staged.Stage("dense", 2, 0.5, search("dense", 4)), staged.Stage("hybrid", 3, 0.5, search("hybrid", 4)), staged.Stage("rerank", 4, None, search("rerank", 4))]
    stops, lists, work = staged.run(questions, stages, docs, score)
    assert seen == [("dense", [f"q{i}" for i in range(6)]), ("hybrid", ["q2", "q3", "q4", "q5"]), ("rerank", ["q4", "q5"])]
    assert sorted((r["qid"], r["level"]) for r in stops.collect()) == [("q0", 1), ("q1", 1), ("q2", 2), ("q3", 2), ("q4", 3), ("q5", 3)]
    assert sorted((r["level"], r["n_questions"], r["n_pairs"]) for r in work.collect()) == [(1, 6, 12), (2, 4, 12), (3, 2, 8)]
    assert {r["qid"]: r["count"] for r in lists.groupBy("qid").count().collect()} == {"q0": 2, "q1": 2, "q2": 3, "q3": 3, "q4": 4, "q5": 4}
    gold = spark.createDataFrame([("q0", 1), ("q2", 9), ("q4", 4), ("q4", 9)], "qid string, doc_id bigint")
    ms = spark.createDataFrame([("dense", 1.0), ("hybrid", 2.0), ("rerank", 3.0)], "method string, ms double")
    told = {r["qid"]: (r["cov"], r["full"], r["ms"], r["fes"]) for r in staged.judged(stops, lists, gold, ms, 3, 0.5).collect()}
    assert told == {"q0": (1.0, True, 1.5, False), "q2": (0.0, False, 3.0, True), "q4": (0.5, False, 4.5, False)}
    assert critic.inputs(questions, lists.filter("qid = 'q0'"), docs, "dense", 1, 2).filter("docs <> ''").count() == 1


def test_text_search_moves_documents_and_not_what_questions_have_in_common_with_them(spark):
    index = lexical.build(corpus(spark), keep=True)
    plan = lexical.bm25_topk(asked(spark), index, 5)._jdf.queryExecution().toString()
    assert re.search(r"hashpartitioning\(qid#\d+, \d+\)", plan) and not re.search(r"hashpartitioning\(qid#\d+, doc_id", plan)


def test_text_search_in_blocks_and_chunks_equals_plain_sums(spark, monkeypatch):
    # repeated words in questions, a document of two lengths under one id, and blocks of few questions
    docs = corpus(spark).union(spark.createDataFrame([(3, "w1 w1 w2"), (3, "w1")], "doc_id bigint, text string"))
    queries = asked(spark).union(spark.createDataFrame([("twice", "w1 w1 w2 w0 w0 w0")], "qid string, question string"))
    index = lexical.build(docs, keep=True)
    terms = queries.select("qid", F.explode(lexical.X.tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    part = lexical.X.scaled(F.col("qtf") * F.col("idf") * lexical.share(index.avgdl))
    sums = terms.join(index.idf, "term").join(index.postings, "term").groupBy("qid", "doc_id").agg(F.sum(part).alias("score")).filter("score > 0")
    plain = rows(dense.ranked(sums, 7, F.desc("score"), "doc_id"))
    assert rows(lexical.bm25_topk(queries, index, 7)) == plain
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 9)
    monkeypatch.setattr(lexical, "CHUNK", 50)
    assert rows(lexical.bm25_topk(queries, index, 7)) == plain


def test_dense_search_keeps_lists_in_few_tasks_and_scores_in_bounded_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=5).round(1).tolist()) for i in range(300)]
    docs, queries = spark.createDataFrame(vectors, "doc_id bigint, vec array<double>").repartition(30), spark.createDataFrame([(f"q{i}", rng.normal(size=5).round(1).tolist()) for i in range(40)], "qid string, vec array<double>")
    batch = pa.RecordBatch.from_arrays([pa.array(range(300))], ["doc_id"])
    monkeypatch.setattr(dense, "TILE", 900)
    tiles = list(dense._parts(batch, None, 40))
    assert max(b.num_rows * len(q) for b, q in tiles) <= 900 and sorted(i for _, q in tiles for i in q) == list(range(40))
    monkeypatch.setattr(dense, "BLOCK_ENTRIES", 60)
    assert [len(q) for q, _ in dense.query_blocks(queries, 4)] == [15, 15, 10]
    assert dense.few_tasks(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    plan = dense.dense_topk(queries, docs, 4)._jdf.queryExecution().toString()
    assert "Coalesce" in plan
    asked = {r["qid"]: np.array(r["vec"]) for r in queries.collect()}
    plain = [(q, [i for _, i in sorted((-int(np.floor(float(np.add.accumulate(np.array(v) * x)[-1]) * 1e9 + 0.5)), i) for i, v in vectors)[:4]]) for q, x in asked.items()]
    got = {}
    for r in dense.dense_topk(queries, docs, 4).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["doc_id"])
    assert got == dict(plain)


def test_cells_take_their_sample_from_few_rows_and_bound_few_queries_at_a_time(spark, monkeypatch):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.array(F.sin("id"), F.cos("id")).alias("vec"))
    exact = [r["doc_id"] for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(100).collect()]
    assert [r["doc_id"] for r in cells._first_by_hash(docs, 5000, 100).collect()] == exact
    index, seen = cells.build(docs, cells=8, sample=100), []
    monkeypatch.setattr(cells, "TILE_QUERIES", 3)
    bounds = cells.CellIndex.bounds
    monkeypatch.setattr(cells.CellIndex, "bounds", lambda self, q: seen.append(len(q)) or bounds(self, q))
    queries = spark.createDataFrame([(f"q{i}", [float(i), 1.0]) for i in range(7)], "qid string, vec array<double>")
    assert [r[:3] for r in rows(cells.pruned_topk(queries, index, 5)[0])] == [r[:3] for r in rows(dense.dense_topk(queries, docs, 5))]
    assert seen == [3, 3, 1] * 2


def test_block_max_tells_the_best_of_each_task_only(spark, monkeypatch):
    index, seen, sums = lexical.build(corpus(spark), keep=True), [], blockmax._sums
    monkeypatch.setattr(blockmax, "_sums", lambda *a: seen.append(sums(*a)) or seen[-1])
    top, _ = blockmax.pruned_topk(asked(spark), blockmax.build(index), 3)
    assert rows(top) == rows(lexical.bm25_topk(asked(spark), index, 3))
    cores = spark.sparkContext.defaultParallelism
    assert len(seen) == 2 and all(0 < s.count() <= 12 * cores * (3 + 1) for s in seen)


def test_passages_are_found_whatever_the_slices_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(matching, "SLICE", 3)
    docs = spark.createDataFrame([(i, f"some words and number{i % 4} here" if i % 5 else None) for i in range(20)], "doc_id bigint, text string").coalesce(1)
    passages = spark.createDataFrame([(1, "and number1"), (2, "words and"), (3, "")], "item_id bigint, text string")
    plain = sorted([(1, i) for i in range(20) if i % 5 and i % 4 == 1] + [(2, i) for i in range(20) if i % 5])
    assert sorted(map(tuple, matching.containing(docs, passages).collect())) == plain


def noise(n, words=60):
    rng = random.Random(11)
    return [" ".join(f"{rng.getrandbits(48):012x}" for _ in range(words)) for _ in range(n)]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_texts_that_no_list_asks_for_do_not_move(spark, shuffled, tmp_path, monkeypatch, limit):
    texts = noise(1000)
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(path)
    docs, size = spark.read.parquet(path), sum(map(len, texts))
    pool = spark.createDataFrame([("q", d, r) for r, d in enumerate((7, 500, 900), 1)], "qid string, doc_id bigint, rank int")
    question = spark.createDataFrame([("q", " ".join(texts[900].split()[:4]))], "qid string, question string")
    runs = pool.withColumn("method", F.lit("dense"))
    cov = spark.createDataFrame([("q", 1, "dense", 3, True)], "qid string, level int, method string, k int, full boolean")
    monkeypatch.setattr(files, "BROADCAST_IDS", limit)
    told = []
    moved = [
        shuffled(lambda: told.append([r["doc_id"] for r in fusion.rerank(pool, question, docs).orderBy("rank").collect()])),
        shuffled(lambda: told.append(critic.samples(question, runs, docs, cov).first()["docs"])),
        shuffled(lambda: told.append(critic.inputs(question, pool, docs, "dense", 1, 3).first()["docs"])),
    ]
    heads = " ".join(" ".join(texts[d].split()[:48]) for d in (7, 500, 900))
    assert told == [[900, 7, 500], heads, heads]
    if limit:
        assert max(moved) < size / 20


def test_gold_of_equal_texts_moves_digests_only(spark, shuffled, tmp_path):
    texts = noise(600, 90)
    texts[150] = texts[50] = texts[3]
    texts[100] = texts[4] = None
    rows = [(d, t, "en") for d, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, texts[9])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    x, got = Fixtures(spark, str(tmp_path)), []
    moved = shuffled(lambda: got.extend(x.qrels.collect()))
    x.release()
    same = {("d0", 0), *((f"d{a}", b) for a in (50, 150) for b in (3, 50, 150)), *((f"d{i}", i) for i in range(200, 600, 50)), ("b1", 9)}
    assert sorted(map(tuple, got)) == sorted(same)
    assert moved < sum(len(t or "") for t in texts) / 4


def test_an_index_makes_its_postings_once(spark, shuffled, tmp_path):
    texts = noise(400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8).cache()
    docs.count()
    once = shuffled(lambda: lexical.postings(docs).agg(F.sum("tf")).first())
    made = []
    moved = shuffled(lambda: made.append(lexical.build(docs, path=str(tmp_path / "index"))))
    counts = shuffled(lambda: lexical.term_idf(made[0].postings, 400).count())
    docs.unpersist()
    assert moved < 1.2 * (once + counts)
    stored = lexical.Index.read(spark, str(tmp_path / "index"))
    assert (stored.n, stored.words) == (400, 400 * 60) and stored.postings.count() == 400 * 60


def test_an_index_that_is_kept_moves_no_text_and_equals_one_that_moves_it(spark, shuffled, tmp_path):
    texts = [*noise(1000), None, "", "a of", "w1 w1 w2 w1", "b2-c w1 it's"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5).write.parquet(str(tmp_path / "docs"))
    docs, made, size = spark.read.parquet(str(tmp_path / "docs")), [], sum(len(t or "") for t in texts)
    queries = spark.createDataFrame([(f"q{d}", " ".join(texts[d].split()[:6]) + " w1 w1 it's") for d in range(0, 1000, 50)], "qid string, question string")
    counted = shuffled(lambda: lexical.term_idf(lexical.postings(docs).localCheckpoint(), len(texts)).count()) - shuffled(lambda: lexical.postings(docs).count())
    moved = shuffled(lambda: made.append(lexical.build(docs, keep=True)))
    kept, plain = made[0], lexical.build(docs)
    assert moved < counted + size / 4
    assert (kept.n, kept.words) == (plain.n, plain.words) == (len(texts), 60_000 + 7)
    assert sorted(kept.postings.collect()) == sorted(plain.postings.collect()) and kept.postings.dtypes == plain.postings.dtypes
    best = rows(lexical.bm25_topk(queries, plain, 9))
    assert rows(lexical.bm25_topk(queries, kept, 9)) == best
    plan = lexical.bm25_topk(queries, kept, 9)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(qid", plan) and not re.search(r"hashpartitioning\(doc_id", plan)
    told = lambda df: sorted((r["doc_id"], list(r["vec"]), r["norm"]) for r in df.collect())
    assert told(dense.hashed_lists(kept.lists)) == told(dense.hashed(plain.postings))


def test_counts_of_terms_meet_in_more_tasks_where_there_are_more_documents(spark, monkeypatch):
    seen, kept = [], files.kept
    monkeypatch.setattr(lexical, "TASK_DOCS", 10)
    monkeypatch.setattr(files, "kept", lambda df: seen.append(spark.conf.get("spark.sql.shuffle.partitions")) or kept(df))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    lexical.build(corpus(spark).limit(0).union(spark.createDataFrame(list(enumerate(noise(120))), "doc_id bigint, text string")), keep=True)
    assert seen == ["12"] and spark.conf.get("spark.sql.shuffle.partitions") == was


def test_tasks_that_seek_passages_are_sent_few_texts_at_a_time(spark):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(rows)
    spark.conf.set(rows, "10000")
    try:
        docs = spark.createDataFrame([(i, f"text {i} end") for i in range(3000)], "doc_id bigint, text string").coalesce(1)
        found = matching.containing(docs, spark.createDataFrame([(1, "text 2999 end")], "item_id bigint, text string"))
        assert [tuple(r) for r in found.collect()] == [(1, 2999)] and int(spark.conf.get(rows)) <= 1000
    finally:
        spark.conf.set(rows, was)


def test_blocks_move_no_posting_and_hold_documents_of_two_lengths(spark, shuffled, tmp_path, monkeypatch):
    texts = noise(1000)
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5).write.parquet(str(tmp_path / "docs"))
    index, told = lexical.build(spark.read.parquet(str(tmp_path / "docs")), keep=True), []
    queries = spark.createDataFrame([(f"q{d}", " ".join(texts[d].split()[:6])) for d in range(0, 1000, 50)], "qid string, question string")
    size = sum(map(len, texts))
    terms = shuffled(lambda: queries.join(index.idf, queries["question"] == index.idf["term"]).count())
    moved = shuffled(lambda: told.append(blockmax.pruned_topk(queries, blockmax.build(index), 3)[0].collect()))
    assert len(told[0]) == 20 and moved < terms + size / 4
    # segments of few postings; documents under one id, of different and of equal lengths
    monkeypatch.setattr(blockmax, "BLOCK", 300)
    monkeypatch.setattr(lexical, "LISTS", 10)
    docs = corpus(spark).union(spark.createDataFrame([(3, "w1 w1 w2"), (3, "w1"), (5, "w1 w9"), (5, "w2 w9")], "doc_id bigint, text string"))
    index = lexical.build(docs, keep=True)
    made = blockmax.build(index)
    assert index.lists is None and made.blocks.count() > 4 and made.blocks.filter("size(of) > 0").count()
    rows_of = made.blocks.select(F.explode("docs").alias("d")).groupBy("d").count()
    assert rows_of.filter("count > 1").count() == 0
    for k in (2, 10, 1000):
        assert rows(blockmax.pruned_topk(asked(spark), made, k)[0]) == rows(lexical.bm25_topk(asked(spark), index, k))


def test_stages_are_timed_by_one_search_each(spark, data, monkeypatch):
    from budgetlens.plans.queries import QUERIES

    seen, by_vectors, by_words = [], dense.dense_topk, lexical.bm25_topk
    monkeypatch.setattr(dense, "dense_topk", lambda *a, **b: seen.append("dense") or by_vectors(*a, **b))
    monkeypatch.setattr(lexical, "bm25_topk", lambda *a, **b: seen.append("bm25") or by_words(*a, **b))
    fixtures.release()
    told = {r["stage"]: r for r in QUERIES["stage_latency"](spark, data).collect()}
    assert sorted(seen) == ["bm25", "dense"]
    x, top = fixtures.fixtures(spark, data), lambda df, k: df.filter(F.col("rank") <= k).count()
    counts = {"dense": top(x.dense200, 20), "bm25": x.bm25.count(), "hybrid": x.hybrid.count(), "rerank": x.reranked.count()}
    assert {s: r["n_rows"] for s, r in told.items()} == counts and all(r["ms"] > 0 for r in told.values())


def test_dense_search_sorts_only_what_reaches_the_kth_best(monkeypatch):
    rng, sizes, partition = np.random.default_rng(8), [], np.partition
    monkeypatch.setattr(dense, "ROWS", 500)
    monkeypatch.setattr(np, "partition", lambda a, n: sizes.append(len(a)) or partition(a, n))
    docs, queries = rng.normal(size=(5000, 6)).round(1), rng.normal(size=(20, 6)).round(1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(docs.tolist()), pa.array(np.ones(5000))], ["doc_id", "vec", "norm"])
    found = pa.Table.from_batches(dense._search([f"q{i}" for i in range(20)], queries, 7, False)([batch.slice(i, 500) for i in range(0, 5000, 500)])).to_pylist()
    for q in range(20):
        score = np.floor(dense._exact(docs, queries[q]) * 1e9 + 0.5)
        assert sorted(r["doc_id"] for r in found if r["qid"] == f"q{q}") == sorted(np.lexsort((np.arange(5000), -score))[:7].tolist())
    assert sum(sizes) < 20 * 5000 / 4
