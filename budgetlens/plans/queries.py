"""The engine's queries over the test tables, by name: (spark, input folder) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..operators import blockmax, cells, coverage, critic, dense, fusion, lexical, metrics, policy, staged, sweep, text_critic
from ..sources import capped, construct, files, report
from . import latency
from .fixtures import Fixtures, fixtures
from .models import letters, plain_chat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Recall floor of the selection queries; the fixed floor is not reached at every scale of the test data.
FLOOR = 0.6
ANSWERS = ("easy", "Medium.", "  HARD\n", "uneasy", "", "hard or easy")


def query(f: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(fixtures(spark, sf_dir))
    return f


#: Means of fractions, whose last digits hang on the order of their sums.
MEANS = {"recall", "best_recall", "mean_ms", *(f"r{k}" for k in S.KS)}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c in MEANS else F.col(c) for c in df.columns])


@query
def dense_topk(x: Fixtures) -> DataFrame:
    vectors = x.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    asked = vectors.filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").cast("string").alias("qid"), "vec")
    return dense.dense_topk(asked, vectors, 20)


@query
def tokenize_terms(x: Fixtures) -> DataFrame:
    return x.docs.select(F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query
def token_counts(x: Fixtures) -> DataFrame:
    return x.docs.select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_tokens"), F.size(X.raw_tokens(F.col("text"))).alias("n_raw"), X.word_count(F.col("text")).alias("n_words"))


@query
def first_words(x: Fixtures) -> DataFrame:
    return x.docs.select("doc_id", X.first_words(F.col("text")).alias("head"))


@query
def bm25_idf(x: Fixtures) -> DataFrame:
    return x.index.idf.select("term", "df", X.scaled(F.col("idf")).alias("idf"))


def _listed(run: DataFrame, score) -> DataFrame:
    return run.select("qid", "doc_id", "rank", score.alias("score"))


@query
def bm25_topk(x: Fixtures) -> DataFrame:
    return _listed(x.bm25, F.col("score"))


@query
def dense_hashed_topk(x: Fixtures) -> DataFrame:
    return _listed(x.dense200, X.scaled(F.col("score")))


@query
def bm25_blockmax(x: Fixtures) -> DataFrame:
    """What bm25_topk finds, from blocks of postings that can matter."""
    return _listed(blockmax.pruned_topk(x.questions, x.blocks, fusion.POOL)[0], F.col("score"))


@query
def bm25_blockmax_reads(x: Fixtures) -> DataFrame:
    """How many postings each question has, and how many were read and looked up for its first 20."""
    return blockmax.pruned_topk(x.questions, x.blocks, fusion.TOP)[1]


@query
def stored_blockmax_topk(x: Fixtures) -> DataFrame:
    path = files.scratch(x.spark)
    x.blocks.write(path)
    return _listed(blockmax.pruned_topk(x.questions, blockmax.BlockIndex.read(x.spark, path), fusion.TOP)[0], F.col("score"))


@query
def grown_bm25_topk(x: Fixtures) -> DataFrame:
    """BM25 over an index that two batches have made."""
    path, later = files.scratch(x.spark), F.col("doc_id") % 3 == 1
    lexical.build(x.docs.filter(~later), path=path)
    return _listed(lexical.bm25_topk(x.questions, lexical.Index.append(path, x.docs.filter(later)), fusion.POOL), F.col("score"))


@query
def dense_cells_topk(x: Fixtures) -> DataFrame:
    """What dense_hashed_topk finds, without the cells of vectors that cannot matter."""
    asked = dense.hashing_vectors(x.questions, "qid", "question")
    return _listed(cells.pruned_topk(asked, x.cells, fusion.POOL, positive=True)[0], X.scaled(F.col("score")))


@query
def dense_cells_reads(x: Fixtures) -> DataFrame:
    """How many vectors there are and how many were scored for each question's first 20."""
    return cells.pruned_topk(dense.hashing_vectors(x.questions, "qid", "question"), x.cells, fusion.TOP, positive=True)[1]


@query
def rrf_hybrid(x: Fixtures) -> DataFrame:
    return _listed(x.hybrid, F.col("score"))


@query
def rerank_lexical(x: Fixtures) -> DataFrame:
    return _listed(x.reranked, F.col("score"))


@query
def ranked_lists(x: Fixtures) -> DataFrame:
    return files.ranked_lists(x.runs, "method").select("method", "qid", F.concat_ws(",", F.transform("ranked", lambda d: d.cast("string"))).alias("ranked"))


@query
def run_variant(x: Fixtures) -> DataFrame:
    """The rerank runs under two names, of which the preferred one is read; dense has only the other."""
    both = x.runs.filter("method = 'rerank'").withColumn("variant", F.lit("large")).union(x.runs.filter("method <> 'hybrid'").withColumn("variant", F.lit("base")))
    return files.preferred(both, ("large", "base")).groupBy("method", "variant").agg(F.count("*").alias("n"))


@query
def recall_matrix(x: Fixtures) -> DataFrame:
    grid = tuple((f"{m}@{k}", m, k) for m in ("dense", "hybrid", "rerank") for k in S.KS)
    return rounded(metrics.recall_matrix(x.cov(grid), "dataset").select("dataset", "method", "k", "n_queries", "recall"))


def _grid(x: Fixtures) -> DataFrame:
    return x.cov(tuple((f"{m}@{k}", m, k) for m in ("dense", "hybrid", "rerank") for k in S.KS))


@query
def recall_pivot(x: Fixtures) -> DataFrame:
    return rounded(metrics.recall_pivot(_grid(x), S.KS, "dataset"))


@query
def hit_matrix(x: Fixtures) -> DataFrame:
    return metrics.recall_matrix(_grid(x), "dataset").select("dataset", "method", "k", "hit_rate")


@query
def full_coverage(x: Fixtures) -> DataFrame:
    return metrics.recall_matrix(_grid(x), "dataset").select("dataset", "method", "k", "full_rate")


@query
def per_query_eval(x: Fixtures) -> DataFrame:
    return x.cov(S.STRATEGIES8).select("qid", "name", "n_hit", "n_gold", "cov", "full")


@query
def best_ranks(x: Fixtures) -> DataFrame:
    return coverage.best_ranks(x.runs, x.qrels).withColumn("best", F.col("best").cast("double"))


@query
def difficulty(x: Fixtures) -> DataFrame:
    return x.difficulty


@query
def difficulty_dist(x: Fixtures) -> DataFrame:
    return metrics.shares(x.difficulty.join(x.questions, "qid"), "difficulty", ("easy", "medium", "hard"), "dataset")


@query
def recall_by_difficulty(x: Fixtures) -> DataFrame:
    return rounded(metrics.recall_matrix(_grid(x).join(x.difficulty, "qid"), "dataset", "difficulty").select("dataset", "difficulty", "method", "k", "n_queries", "recall"))


@query
def recall_by_group(x: Fixtures) -> DataFrame:
    many = _grid(x).withColumn("gold_group", F.when(F.col("n_gold") >= 2, "2+").otherwise("1"))
    return rounded(metrics.recall_matrix(many, "grp", "gold_group").select("grp", "gold_group", "method", "k", "n_queries", "recall"))


def _summary(cov: DataFrame) -> DataFrame:
    return cov.groupBy("dataset", "name").agg(F.count("*").alias("n_queries"), F.avg("cov").alias("recall"), F.avg(F.col("full").cast("int")).alias("full_rate"), F.avg("n_docs").alias("mean_docs"))


@query
def fixed_strategies(x: Fixtures) -> DataFrame:
    return rounded(_summary(x.cov(S.STRATEGIES8).filter(F.col("name").isin(*S.FIXED))))


@query
def oracle_pick7(x: Fixtures) -> DataFrame:
    return policy.oracle_pick(x.cov(S.STRATEGIES7)).select("qid", "name", "level", "cov", "full")


@query
def oracle_pick8(x: Fixtures) -> DataFrame:
    return policy.oracle_pick(x.cov(S.STRATEGIES8)).select("qid", "name", "level", "cov", "full")


@query
def oracle_summary(x: Fixtures) -> DataFrame:
    return rounded(policy.oracle_summary(x.cov(S.STRATEGIES7), "dataset"))


@query
def rule_router(x: Fixtures) -> DataFrame:
    users = x.table("conversations").filter("role = 'user'").select(F.format_string("c%d-%d", "conv_id", "turn").alias("qid"), F.col("text").alias("question"))
    asked = users.union(x.questions.select("qid", "question"))
    return asked.select("qid", X.word_count(F.col("question")).alias("n_words"), X.entity_count(F.col("question")).alias("n_entities"), policy.rule_label(F.col("question")).alias("label"))


@query
def label_parse(x: Fixtures) -> DataFrame:
    """Labels that answers hold: what a model may say, before a turn of a conversation."""
    said = F.get(F.array(*map(F.lit, ANSWERS)), ((F.col("conv_id") + F.col("turn")) % len(ANSWERS)).cast("int"))
    answer = F.concat_ws(" ", said, "text")
    return x.table("conversations").select("conv_id", "turn", X.label_or_easy(answer).alias("label"), X.parsed_label(answer).isNull().alias("unparsed"))


@query
def router_systems(x: Fixtures) -> DataFrame:
    return rounded(policy.system_table(x.cov(S.STRATEGIES8), {"rule": x.rule, "model": x.model}, x.runs, x.qrels, x.difficulty))


@query
def router_accuracy(x: Fixtures) -> DataFrame:
    return policy.router_accuracy(x.rule, x.difficulty)


def _ladder(x: Fixtures, name: str) -> DataFrame:
    return policy.ladder_stop(x.cov(S.LADDERS[name]))


@query
def early_stop_a(x: Fixtures) -> DataFrame:
    return _ladder(x, "A").select("qid", "level", "name", "cov", "full")


@query
def early_stop_b(x: Fixtures) -> DataFrame:
    return _ladder(x, "B").select("qid", "level", "name", "cov", "full")


@query
def early_stop_3(x: Fixtures) -> DataFrame:
    return _ladder(x, "3").select("qid", "level", "name", "cov", "full")


@query
def stage_distribution(x: Fixtures) -> DataFrame:
    parts = [policy.stage_distribution(_ladder(x, n), S.strategies(x.spark, rows)).withColumn("ladder", F.lit(n)) for n, rows in S.LADDERS.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query
def ladder_latency(x: Fixtures) -> DataFrame:
    ms = S.stage_latencies(x.spark)
    parts = [policy.ladder_summary(_ladder(x, n), ms, "dataset").withColumn("ladder", F.lit(n)) for n in S.LADDERS]
    return rounded(parts[0].union(parts[1]).union(parts[2]))


@query
def critic_samples(x: Fixtures) -> DataFrame:
    return x.samples.select("qid", "phase", "level", "k", "docs", "label", F.concat_ws(",", F.transform("ranked", lambda d: d.cast("string"))).alias("ranked"))


@query
def critic_scores(x: Fixtures) -> DataFrame:
    return x.scores.select("qid", "phase", "label", X.scaled(F.col("p")).alias("p"))


@query
def critic_confusion(x: Fixtures) -> DataFrame:
    return metrics.confusion(x.scores)


def _stops(x: Fixtures, split: str | None = None, config: str | None = None) -> DataFrame:
    scores = x.scores if split is None else x.scores.join(x.split.filter(F.col("split") == split), "qid", "left_semi")
    configs = S.configs(x.spark) if config is None else S.configs(x.spark).filter(F.col("config") == config)
    return critic.early_stop(x.cov(S.LADDER_3), scores, configs, S.stage_latencies(x.spark))


#: The configuration of which single stops are shown, and its threshold.
HALF, HALF_AT = "t=0.50", 0.5


@query
def critic_early_stop(x: Fixtures) -> DataFrame:
    return _stops(x, config=HALF).select("qid", "level", "method", "k", "cov", "full", F.round("ms", 6).alias("ms"), "fes")


def _ladder_run(x: Fixtures) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ladder of dense, hybrid and rerank, run: BM25 and pairs are worked on for the questions that are left only."""
    pools: dict[str, DataFrame] = {}

    def by_vectors(todo: DataFrame) -> DataFrame:
        pools["dense"] = files.kept(dense.dense_topk(dense.hashing_vectors(todo, "qid", "question"), x.vectors, fusion.POOL, positive=True))
        return pools["dense"]

    def fused(todo: DataFrame) -> DataFrame:
        pools["hybrid"] = files.kept(fusion.rrf([pools["dense"].join(todo.select("qid"), "qid", "left_semi"), lexical.bm25_topk(todo, x.index, fusion.POOL)]))
        return pools["hybrid"]

    left = lambda todo: pools["hybrid"].join(todo.select("qid"), "qid", "left_semi")
    search = {"dense": by_vectors, "hybrid": fused, "rerank": lambda todo: fusion.rerank(left(todo), todo, x.docs)}
    last = len(S.LADDER_3) - 1
    stages = [staged.Stage(m, k, HALF_AT if i < last else None, search[m], left if m == "rerank" else lambda todo, m=m: pools[m]) for i, (_, m, k) in enumerate(S.LADDER_3)]
    return staged.run(x.questions.select("qid", "question"), stages, x.docs)


@query
def critic_ladder_run(x: Fixtures) -> DataFrame:
    """What critic_early_stop tells, by a ladder whose later stages run for unsatisfied questions only."""
    stops, lists, _ = _ladder_run(x)
    out = staged.judged(stops, lists, x.qrels, S.stage_latencies(x.spark), len(S.LADDER_3))
    return out.withColumn("ms", F.round("ms", 6))


@query
def critic_ladder_work(x: Fixtures) -> DataFrame:
    """How many questions and rows each stage of the run ladder had: list entries, for rerank pairs that were scored."""
    return _ladder_run(x)[2]


@query
def fes_rate(x: Fixtures) -> DataFrame:
    return _stops(x).groupBy("config").agg(F.count("*").alias("n_queries"), F.count_if("fes").alias("n_fes"), F.avg(F.col("fes").cast("int")).alias("fes"))


def _table(x: Fixtures, split: str) -> DataFrame:
    table = sweep.evaluate(_stops(x, split))
    return table.select(*[F.round(c, 9).alias(c) if c in ("recall", "ms") else F.col(c) for c in table.columns])


@query
def policy_sweep(x: Fixtures) -> DataFrame:
    return _table(x, "val")


@query
def policy_select(x: Fixtures) -> DataFrame:
    """The configuration chosen on val, with its metrics on test."""
    best = sweep.select(_table(x, "val"), FLOOR).select("config")
    return _table(x, "test").join(best, "config", "left_semi")


@query
def policy_cheapest(x: Fixtures) -> DataFrame:
    return sweep.cheapest(sweep.grid(_table(x, "val")), 10, FLOOR).select("config", "recall", "docs")


@query
def pareto_front(x: Fixtures) -> DataFrame:
    return sweep.pareto(_table(x, "val"), FLOOR).select("config", "recall", "docs")


def _false_stops(x: Fixtures) -> DataFrame:
    return sweep.false_stops(_stops(x, config=HALF), x.samples, x.scores, x.qrels, x.cov(S.LADDER_3))


@query
def fes_diagnostics(x: Fixtures) -> DataFrame:
    each = _false_stops(x).select("qid", "stop_stage", "coverage_at_stop", "would_continue", F.array_join(F.transform("gold_docs", lambda d: d.cast("string")), ",").alias("gold_docs"), F.explode("stages").alias("phase", "v"))
    return each.select("qid", "stop_stage", "coverage_at_stop", "would_continue", "gold_docs", "phase", "v.k", "v.coverage", F.array_join(F.transform("v.covered_gold", lambda d: d.cast("string")), ",").alias("covered_gold"), X.scaled(F.col("v.critic_p")).alias("critic_p"))


@query
def fes_summary(x: Fixtures) -> DataFrame:
    out = sweep.false_stop_summary(_false_stops(x))
    return out.select("n", *[X.scaled(F.col(c)).alias(c) for c in ("min_p", "max_p")], F.round("mean_p", 9).alias("mean_p"), "half_share", "n_would_continue")


@query
def gap_report(x: Fixtures) -> DataFrame:
    cov = x.cov(S.LADDER_3)
    of = lambda df: df.agg(F.avg("cov").alias("recall"), F.avg(F.col("full").cast("int")).alias("full_rate"), F.avg("k").alias("docs"))
    out = sweep.gap(of(policy.ladder_stop(cov)), of(_stops(x, config=HALF)))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


KB, SAMPLE = 500, (("test", 100), ("train", 540), ("val", 100))


def _gold_docs(x: Fixtures) -> DataFrame:
    return x.qrels.filter("qid like 'b%'")


@query
def kb_build(x: Fixtures) -> DataFrame:
    return construct.knowledge_base(x.docs, _gold_docs(x), KB).select("doc_id", "is_gold")


@query
def kb_answerable(x: Fixtures) -> DataFrame:
    kb = construct.knowledge_base(x.docs, _gold_docs(x), KB)
    return construct.answerable(x.questions, x.qrels, kb).select("qid", "n_gold")


@query
def split_assign(x: Fixtures) -> DataFrame:
    return construct.splits(x.docs.select(F.col("doc_id").alias("qid")), SAMPLE).select("qid", "split")


@query
def leakage_check(x: Fixtures) -> DataFrame:
    rows = construct.splits(x.docs.select(F.col("doc_id").alias("qid")), SAMPLE)
    of = lambda name: rows.filter(F.col("split") == name)
    return sweep.leakage(of("test"), of("train"), of("val"))


@query
def latency_summary(x: Fixtures) -> DataFrame:
    out = metrics.latency_summary(x.table("events"), "value", "event_type")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")])


@query
def critic_ml(x: Fixtures) -> DataFrame:
    """The trained critic's scores on the test half; it learns from the other, split once more for validation."""
    val = X.hash16(F.concat(F.lit("v"), "qid")) % 4 == 0
    rows = x.samples.join(x.split, "qid")
    learn = rows.filter("split = 'val'")
    model, _ = critic.train(learn.filter(~val), learn.filter(val))
    return critic.scored(model, rows.filter("split = 'test'")).select("qid", "phase", "label", "p")


@query
def critic_text(x: Fixtures) -> DataFrame:
    """critic_ml with the critic that reads the texts: trained by mini-batches, the best epoch of the validation part."""
    val = X.hash16(F.concat(F.lit("v"), "qid")) % 4 == 0
    rows = x.samples.join(x.split, "qid")
    learn = rows.filter("split = 'val'")
    model = text_critic.train(learn.filter(~val), learn.filter(val))
    return text_critic.scored(model, rows.filter("split = 'test'").select("qid", "question", "phase", "label", "docs")).select("qid", "phase", "label", "p")


@query
def stage_latency(x: Fixtures) -> DataFrame:
    """Time of each retrieval stage for all questions, with the rows that Spark observed in it.

    Each search runs once and its lists are written; a stage's time is what it adds to those whose lists it reads.
    """
    lists: dict[str, DataFrame] = {}

    def held(name: str, made: DataFrame) -> DataFrame:
        lists[name] = files.kept(made)
        return lists[name]

    asked = dense.hashing_vectors(x.questions, "qid", "question")
    n = x.questions.count()
    return latency.observed(x.spark, {
        "dense": lambda: held("dense", dense.dense_topk(asked, x.vectors, fusion.POOL, positive=True)).filter(F.col("rank") <= fusion.TOP),
        "bm25": lambda: held("bm25", lexical.bm25_topk(x.questions, x.index, fusion.POOL)),
        "hybrid": lambda: held("hybrid", fusion.rrf([lists["dense"], lists["bm25"]])), "rerank": lambda: fusion.rerank(lists["hybrid"], x.questions, x.docs),
    }, n)


PHASES = {"dense": "dense200", "bm25": "bm25", "hybrid": "hybrid", "rerank": "reranked"}


def retrieve(x: Fixtures, phase: str, k: int = 20) -> DataFrame:
    """(qid, doc_id, rank, score): the first k of each question's list of a phase; only what it needs is built."""
    return getattr(x, PHASES[phase]).filter(F.col("rank") <= k)


# -- sources, sinks and construction, on rows derived from the tables ------------------------------------------------


def _short_rows(x: Fixtures) -> DataFrame:
    """Raw rows with one document and question each: spans follow from ids; some rows lack tokens, question or answer."""
    ids = F.col("doc_id")
    span = lambda a, b: F.struct(F.array(a).alias("start_token"), F.array(b).alias("end_token"))
    none = F.array().cast("array<bigint>")
    first = F.when(ids % 2 == 0, F.struct(none.alias("start_token"), none.alias("end_token"))).otherwise(span(ids % 9, ids % 9))
    words = F.when(ids % 13 == 0, F.array().cast("array<string>")).otherwise(F.split("text", " "))
    rows = x.table("documents").select(
        "doc_id", F.struct(F.struct(words.alias("token")).alias("tokens")).alias("document"),
        F.struct(F.when(ids % 11 == 0, "").otherwise(F.array_join(F.slice(words, 1, 8), " ")).alias("text")).alias("question"),
        F.struct(F.array(first, span(ids % 5, ids % 5 + ids % 3)).alias("short_answers"), F.array(F.struct((ids % 4 - 1).alias("start_token"), (ids % 4 - 1 + ids % 6).alias("end_token"))).alias("long_answer")).alias("annotations"),
    )
    return construct.numbered(rows, "doc_id")


def _hop_rows(x: Fixtures) -> DataFrame:
    """Raw rows with several titled contexts: a conversation's turns; some lack the last one's sentences, some any gold."""
    turns = x.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    sentences = F.transform("t", lambda u: F.split(u["text"], r"\. "))
    conv = F.col("conv_id")
    gold = F.when(conv % 3 == 0, F.array(F.lit("t0"))).when(conv % 3 == 1, F.array(F.lit("t1"), F.lit("t2"), F.lit("t2"))).otherwise(F.array(F.lit("none")))
    rows = turns.select(
        "conv_id", F.get("t", F.lit(0))["text"].alias("question"), F.get("t", F.lit(0))["role"].alias("answer"), F.when(conv % 2 == 0, "bridge").otherwise("comparison").alias("type"),
        F.struct(gold.alias("title"), F.transform(gold, lambda _, i: i).alias("sent_id")).alias("supporting_facts"),
        F.struct(F.transform("t", lambda u: F.concat(F.lit("t"), (u["turn"] % 3).cast("string"))).alias("title"), F.when(conv % 4 == 0, F.slice(sentences, F.lit(1), F.size("t") - 1)).otherwise(sentences).alias("sentences")).alias("context"),
    )
    return construct.numbered(rows, "conv_id")


_joined = lambda c: F.array_join(F.transform(c, lambda d: d.cast("string")), ",")


@query
def short_form_docs(x: Fixtures) -> DataFrame:
    return construct.short_form(_short_rows(x), "n")[0]


@query
def short_form_questions(x: Fixtures) -> DataFrame:
    return construct.short_form(_short_rows(x), "n")[1].withColumn("gold_docs", _joined("gold_docs"))


@query
def multi_hop_docs(x: Fixtures) -> DataFrame:
    return construct.multi_hop(_hop_rows(x), "n")[0]


@query
def multi_hop_questions(x: Fixtures) -> DataFrame:
    return construct.multi_hop(_hop_rows(x), "n")[1].withColumn("gold_docs", _joined("gold_docs"))


@query
def multi_hop_qrels(x: Fixtures) -> DataFrame:
    return construct.multi_hop(_hop_rows(x), "n")[2]


#: Caps of the capped scans below: rows and documents of the short form, rows of the other one.
CAPPED_ROWS, CAPPED_DOCS, CAPPED_HOPS = 900, 300, 60


def _stored_rows(x: Fixtures, rows: DataFrame, schema) -> str:
    """The folder of rows(n, ...) as raw files in order."""
    path = files.scratch(x.spark)
    rows.repartitionByRange("n").sortWithinPartitions("n").select(*schema.names).write.option("maxRecordsPerFile", 250).parquet(path)
    return path


def _capped_short(x: Fixtures) -> tuple[DataFrame, DataFrame]:
    return capped.short_form(x.spark, _stored_rows(x, _short_rows(x), S.SHORT_FORM_ROW), most_rows=CAPPED_ROWS, most_docs=CAPPED_DOCS, first=200)


def _capped_hops(x: Fixtures) -> tuple[DataFrame, DataFrame, DataFrame]:
    return capped.multi_hop(x.spark, _stored_rows(x, _hop_rows(x), S.MULTI_HOP_ROW), most_rows=CAPPED_HOPS)


@query
def capped_short_docs(x: Fixtures) -> DataFrame:
    return _capped_short(x)[0]


@query
def capped_short_questions(x: Fixtures) -> DataFrame:
    return _capped_short(x)[1].withColumn("gold_docs", _joined("gold_docs"))


@query
def capped_hop_docs(x: Fixtures) -> DataFrame:
    return _capped_hops(x)[0]


@query
def capped_hop_questions(x: Fixtures) -> DataFrame:
    return _capped_hops(x)[1].withColumn("gold_docs", _joined("gold_docs"))


@query
def sentence_buckets(x: Fixtures) -> DataFrame:
    questions = construct.multi_hop(_hop_rows(x), "n")[1]
    return questions.groupBy(X.sentence_bucket(F.col("n_sent")).alias("bucket")).agg(F.count("*").alias("n"))


@query
def rebuilt_equal(x: Fixtures) -> DataFrame:
    """Whether a knowledge base that is built twice is the same, and whether it equals one of another seed."""
    build = lambda seed: construct.knowledge_base(x.docs, _gold_docs(x), KB, seed).select("doc_id", "is_gold")
    same = construct.same_rows(build(42), build(42).orderBy("doc_id"))
    return x.spark.createDataFrame([(same, construct.same_rows(build(42), build(43)))], "same boolean, other_seed boolean")


@query
def dataset_file(x: Fixtures) -> DataFrame:
    """The benchmark as a dataset file and back."""
    path, items = files.scratch(x.spark), x.table("benchmark")
    item = F.col("item_id").cast("string")
    questions = items.select(F.concat(F.lit("b"), item).alias("qid"), F.array_join(F.slice(F.split("text", " "), 1, 10), " ").alias("question"), F.lit("").alias("answer"), F.array(F.concat(F.lit("i"), item)).alias("gold_docs"))
    files.write_dataset("bench", items.select(F.concat(F.lit("i"), item).alias("doc_id"), "text"), questions, path)
    docs, asked, qrels = files.read_dataset(x.spark, path)
    return asked.join(qrels, ["dataset", "qid"]).join(docs, ["dataset", "doc_id"]).select("dataset", "qid", "question", "doc_id", "text")


@query
def question_index(x: Fixtures) -> DataFrame:
    rows = x.table("conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("qid"), "turn", F.col("text").alias("question"))
    return files.by_qid(rows, "turn").select("qid", "turn", "question")


@query
def stored_vectors_topk(x: Fixtures) -> DataFrame:
    path = files.scratch(x.spark)
    files.write_vectors(x.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), path)
    vectors = files.read_vectors(x.spark, path)
    return dense.dense_topk(vectors.filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").cast("string").alias("qid"), "vec"), vectors, 20)


@query
def stored_bm25_topk(x: Fixtures) -> DataFrame:
    path = files.scratch(x.spark)
    x.index.write(path)
    return _listed(lexical.bm25_topk(x.questions, lexical.Index.read(x.spark, path), fusion.POOL), F.col("score"))


@query
def stored_runs(x: Fixtures) -> DataFrame:
    path = files.scratch(x.spark)
    files.write_runs(x.runs, path)
    return files.read_runs(x.spark, path).select("method", "qid", "doc_id", "rank")


@query
def stored_samples(x: Fixtures) -> DataFrame:
    path = files.scratch(x.spark)
    files.write_samples(x.samples.join(x.split, "qid").withColumn("ranked", F.transform("ranked", lambda d: d.cast("string"))), path)
    return files.read_samples(x.spark, path, "val").select("qid", "question", "phase", "k", "docs", "label", F.array_join("ranked", ",").alias("ranked"))


@query
def stored_gold(x: Fixtures) -> DataFrame:
    path = files.scratch(x.spark)
    files.write_gold(x.qrels.withColumn("doc_id", F.col("doc_id").cast("string")), path)
    return files.read_gold(x.spark, path).select("qid", F.col("doc_id").cast("bigint").alias("doc_id"))


@query
def json_report(x: Fixtures) -> DataFrame:
    path = files.scratch(x.spark)
    report.write_json(QUERIES["recall_matrix"](x.spark, x.sf_dir), path)
    return x.spark.read.schema("dataset string, method string, k int, n_queries bigint, recall double").json(path)


@query
def markdown_report(x: Fixtures) -> DataFrame:
    told = report.markdown(_grid(x).groupBy("method", "k").agg(F.count("*").alias("n"), F.avg("cov").alias("recall"), F.avg(F.col("full").cast("int")).alias("full_rate")), {"recall": ".3f", "full_rate": ".1%"}, ("method", "k"))
    return x.spark.createDataFrame([(i, line) for i, line in enumerate(told.splitlines())], "n int, line string")


@query
def critic_cost(x: Fixtures) -> DataFrame:
    """The critic's time where it was measured, and its default where it was not."""
    held = x.table("events").agg(F.round(F.avg("value"), 6).alias("ms"))
    return files.with_default(held, "ms", S.CRITIC_MS, x.spark).select(F.lit("measured").alias("source"), "ms").union(files.with_default(None, "ms", S.CRITIC_MS, x.spark).select(F.lit("default"), "ms"))


@query
def pair_inputs(x: Fixtures) -> DataFrame:
    return critic.pair_text(critic.usable(x.samples)).select("qid", "phase", "input")


@query
def prompts(x: Fixtures) -> DataFrame:
    return x.questions.select("qid", X.prompt(F.col("question")).alias("prompt"))


@query
def model_labels(x: Fixtures) -> DataFrame:
    return policy.model_label(x.questions, plain_chat).select("qid", "answer", "label", "parsed")


@query
def softmax(x: Fixtures) -> DataFrame:
    z = lambda k: F.get("embedding", F.lit(k)).cast("double") * 10
    return x.table("embeddings").select("vec_id", F.round(X.positive_probability(z(0), z(1)), 9).alias("p"))


@query
def embedded_topk(x: Fixtures) -> DataFrame:
    """Texts and questions through an embedder that runs in Python, then exact search."""
    texts = dense.embedded(x.spread_docs.select("doc_id", "text"), "text", letters).select("doc_id", "vec")
    asked = dense.embedded(x.questions.select("qid", "question"), "question", letters).select("qid", "vec")
    return _listed(dense.dense_topk(asked, texts, 20, positive=True), X.scaled(F.col("score")))


@query
def view_recall(x: Fixtures) -> DataFrame:
    """Recall in SQL, over views of the core tables."""
    x.views()
    return x.spark.sql(VIEW_RECALL)


VIEW_RECALL = """
SELECT r.method, count(g.doc_id) AS hits, count(DISTINCT r.qid) AS n_queries
FROM runs r LEFT JOIN (SELECT DISTINCT qid, doc_id FROM qrels) g ON g.qid = r.qid AND g.doc_id = r.doc_id
WHERE r.rank <= 10 GROUP BY r.method"""
