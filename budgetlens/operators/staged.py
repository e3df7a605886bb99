"""A ladder that runs: later stages search only for questions that earlier ones have not satisfied.

Each stage searches for the questions that are left, the critic scores what it found, and questions that reach the
stage's threshold stop there.  The others are written as a table, which is all that the next stage sees, so what a stage
costs follows from how many questions it gets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..sources import files
from . import critic


@dataclass
class Stage:
    """search: from questions(qid, question, ...) to (qid, doc_id, rank); threshold: None where every question stops.

    ``pairs`` tells how many rows the stage has to look at for the questions it gets, for the report of its work.
    """

    method: str
    k: int
    threshold: float | None
    search: Callable[[DataFrame], DataFrame]
    pairs: Callable[[DataFrame], DataFrame] | None = None


def run(questions: DataFrame, stages: list[Stage], docs: DataFrame, score: Callable[[DataFrame], DataFrame] = critic.lexical_score) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stops(qid, level, method, k, p), lists(qid, doc_id, rank) where they stopped, work(level, method, n_questions, n_pairs)).

    score: from (qid, question, phase, level, k, docs) to the same with p; a null p is under every threshold.
    """
    todo, stops, lists, work = questions, [], [], []
    for level, stage in enumerate(stages, 1):
        found = files.kept(stage.search(todo).filter(F.col("rank") <= stage.k).select("qid", "doc_id", "rank"))
        told = score(critic.inputs(todo, found, docs, stage.method, level, stage.k)).select("qid", "p")
        stop = F.lit(True) if stage.threshold is None else F.coalesce(F.col("p") >= stage.threshold, F.lit(False))
        told = files.kept(told.withColumn("stop", stop))
        stopped = told.filter("stop").select("qid", F.lit(level).alias("level"), F.lit(stage.method).alias("method"), F.lit(stage.k).alias("k"), "p")
        stops.append(stopped)
        lists.append(found.join(stopped.select("qid"), "qid", "left_semi"))
        pairs = stage.pairs(todo) if stage.pairs else found
        counts = told.agg(F.count("*").alias("n_questions")).crossJoin(pairs.agg(F.count("*").alias("n_pairs")))  # a row each
        work.append(counts.select(F.lit(level).alias("level"), F.lit(stage.method).alias("method"), "n_questions", "n_pairs"))
        if level < len(stages):
            todo = files.kept(todo.join(stopped.select("qid"), "qid", "left_anti"))
    union = lambda parts: reduce(DataFrame.union, parts)
    return union(stops), union(lists), union(work)


def judged(stops: DataFrame, lists: DataFrame, qrels: DataFrame, latencies: DataFrame, last: int, critic_ms: float = S.CRITIC_MS) -> DataFrame:
    """stops with cov, full, ms and fes, as critic.early_stop() has them; questions without gold are left out."""
    gold = qrels.distinct()
    golds = gold.groupBy("qid").agg(F.count("*").alias("n_gold"))
    hits = lists.join(gold, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("n_hit"))
    out = stops.join(golds, "qid").join(hits, "qid", "left").join(F.broadcast(latencies), "method")  # a constant relation
    n_hit = F.coalesce("n_hit", F.lit(0))
    out = out.withColumn("cov", n_hit / F.col("n_gold")).withColumn("full", n_hit == F.col("n_gold")).withColumn("ms", F.col("ms") + F.lit(float(critic_ms)) * F.col("level"))
    return out.withColumn("fes", (F.col("level") < last) & ~F.col("full")).select("qid", "level", "method", "k", "cov", "full", "ms", "fes")
