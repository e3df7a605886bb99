"""Questions, gold and runs derived from the tables documents and benchmark.

Dataset ``doc``: every document whose id is divisible by 50 asks with its words 4 to 13; gold are all documents of the
same text.  Dataset ``bench``: every benchmark item asks with its first ten words; gold are the documents that contain
it.  Questions without gold are left out.  Runs: ``dense`` by hashed token counts, ``hybrid`` by its fusion with BM25,
``rerank`` the hybrid list by the share of the question's word pairs that a document contains.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..operators import blockmax, cells, coverage, critic, dense, fusion, lexical, matching, policy
from ..sources import files
from . import models


def _words(text: str, start: int, n: int = 10):
    return F.array_join(F.slice(F.split(text, " "), start, n), " ")


class Fixtures:
    """Lazily built tables, each kept in the session's storage for as long as the object lives."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.held = spark, sf_dir, []

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("documents").select("doc_id", "text", "lang")

    @cached_property
    def spread_docs(self) -> DataFrame:
        return lexical.spread(self.docs)

    @cached_property
    def _asking(self) -> DataFrame:
        doc = self.docs.filter(F.col("doc_id") % 50 == 0).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("qid"), F.lit("doc").alias("dataset"), _words("text", 4).alias("question"), F.col("lang").alias("grp"))
        bench = self.table("benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("qid"), F.lit("bench").alias("dataset"), _words("text", 1).alias("question"), F.lit("bench").alias("grp"))
        return doc.union(bench)

    @cached_property
    def qrels(self) -> DataFrame:
        # equal texts are told by their digests: no text moves
        told = self.docs.filter("text is not null").select("doc_id", F.unhex(F.sha2("text", 256)).alias("h"))
        asks = told.filter(F.col("doc_id") % 50 == 0).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("qid"), "h")
        same = told.join(asks, "h").select("qid", "doc_id")
        held = matching.containing(self.spread_docs, self.table("benchmark")).select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("qid"), "doc_id")
        return same.union(held).persist()

    @cached_property
    def questions(self) -> DataFrame:
        """(qid, dataset, question, grp, n_gold)."""
        golds = self.qrels.distinct().groupBy("qid").agg(F.count("*").alias("n_gold"))
        return self._asking.join(golds, "qid").persist()

    @cached_property
    def index(self) -> lexical.Index:
        return lexical.build(self.docs, keep=True)

    @cached_property
    def bm25(self) -> DataFrame:
        return lexical.bm25_topk(self.questions, self.index, fusion.POOL).persist()

    @cached_property
    def dense200(self) -> DataFrame:
        asked = dense.hashing_vectors(self.questions, "qid", "question")
        return dense.dense_topk(asked, self.vectors, fusion.POOL, positive=True).persist()

    @cached_property
    def vectors(self) -> DataFrame:
        lists = self.index.lists
        return (dense.hashed(self.index.postings) if lists is None else dense.hashed_lists(lists)).persist()

    @cached_property
    def hybrid(self) -> DataFrame:
        return fusion.rrf([self.dense200, self.bm25]).persist()

    @cached_property
    def reranked(self) -> DataFrame:
        return fusion.rerank(self.hybrid, self.questions, self.docs).persist()

    @cached_property
    def blocks(self) -> blockmax.BlockIndex:
        return blockmax.build(self.index)

    @cached_property
    def cells(self) -> cells.CellIndex:
        return cells.build(self.vectors)

    def _kept(self, **tables: DataFrame) -> dict[str, DataFrame]:
        """Tables written by question, as read from there."""
        path = files.scratch(self.spark)
        files.write_facts(tables, path)
        held = files.read_facts(self.spark, path)
        self.held += held.values()
        return held

    @cached_property
    def runs(self) -> DataFrame:
        """(method, qid, doc_id, rank), bucketed by question."""
        named = {"dense": self.dense200.filter(F.col("rank") <= fusion.TOP), "hybrid": self.hybrid, "rerank": self.reranked}
        parts = [df.select(F.lit(m).alias("method"), "qid", "doc_id", "rank") for m, df in named.items()]
        return self._kept(runs=parts[0].union(parts[1]).union(parts[2]))["runs"]

    @cached_property
    def facts(self) -> DataFrame:
        """Coverage of each question by each method at each cut, with dataset and grp, bucketed by question."""
        grid = tuple((f"{m}@{k}", m, k) for m in ("dense", "hybrid", "rerank") for k in S.KS)
        out = coverage.coverage(self.runs, self.qrels, S.strategies(self.spark, grid)).drop("level", "name")
        return self._kept(facts=out.join(self.questions.select("qid", "dataset", "grp"), "qid"))["facts"]

    def cov(self, rows: S.Strategies) -> DataFrame:
        """Coverage with the questions' dataset and grp: the facts of some strategies, whose cuts are those of the facts."""
        return coverage.chosen(self.facts, rows)

    @cached_property
    def difficulty(self) -> DataFrame:
        return self._kept(difficulty=coverage.difficulty(self.runs, self.qrels))["difficulty"]

    @cached_property
    def rule(self) -> DataFrame:
        return self.questions.select("qid", "question", policy.rule_label(F.col("question")).alias("label"))

    @cached_property
    def model(self) -> DataFrame:
        return policy.model_label(self.questions, models.plain_chat).select("qid", "label")

    def views(self) -> None:
        """Temporary views of the core tables, by their names."""
        for name in ("docs", "questions", "qrels", "runs", "difficulty", "samples", "scores", "split"):
            getattr(self, name).createOrReplaceTempView(name)
        self.index.postings.createOrReplaceTempView("postings")
        self.index.idf.createOrReplaceTempView("idf")

    @cached_property
    def samples(self) -> DataFrame:
        return critic.samples(self.questions, self.runs, self.docs, self.cov(S.LADDER_3)).persist()

    @cached_property
    def scores(self) -> DataFrame:
        """(qid, phase, level, label, p)."""
        return critic.lexical_score(self.samples).select("qid", "phase", "level", "label", "p").persist()

    @cached_property
    def split(self) -> DataFrame:
        return self.questions.select("qid", F.when(X.hash16(F.col("qid")) % 2 == 0, "val").otherwise("test").alias("split"))

    def release(self) -> None:
        for name in ("qrels", "questions", "vectors", "bm25", "dense200", "hybrid", "reranked", "samples", "scores"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()
        files.forget(*self.held)
        if "index" in self.__dict__:
            (self.index.postings if self.index.lists is None else self.index.lists).unpersist()


_HELD: dict[str, Fixtures] = {}


def fixtures(spark: SparkSession, sf_dir: str) -> Fixtures:
    """The tables of one input; those of the last input are released when another is asked for."""
    key = f"{spark.sparkContext.applicationId}:{sf_dir}"
    if key not in _HELD:
        release()
        _HELD[key] = Fixtures(spark, sf_dir)
    return _HELD[key]


def release() -> None:
    while _HELD:
        _, old = _HELD.popitem()
        try:
            old.release()
        except Exception:  # noqa: BLE001  the session that held them is gone
            pass
