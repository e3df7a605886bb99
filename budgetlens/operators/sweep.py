"""Threshold sweep: evaluation of configurations, constrained selection, Pareto front, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S

_rate = lambda c: F.avg(c.cast("int"))


def evaluate(stops: DataFrame) -> DataFrame:
    """A row of metrics for each configuration of critic.early_stop()."""
    at = lambda n: F.count_if(F.col("level") == n)
    return stops.groupBy("config_ord", "config", "t_dense", "t_hybrid").agg(
        F.count("*").alias("n_queries"), F.avg("cov").alias("recall"), _rate(F.col("full")).alias("full_rate"), F.avg("k").alias("docs"), F.avg("ms").alias("ms"), _rate(F.col("fes")).alias("fes"),
        at(1).alias("n_dense"), at(2).alias("n_hybrid"), at(3).alias("n_rerank"),
    )


def feasible(table: DataFrame, floor: float = S.RECALL_FLOOR) -> DataFrame:
    return table.filter(F.col("recall") >= F.lit(float(floor)))


def select(table: DataFrame, floor: float = S.RECALL_FLOOR, strict: bool = False) -> DataFrame:
    """The feasible configuration of fewest documents, the first of equal ones.  strict: an error if there is none."""
    best = feasible(table, floor).orderBy("docs", "config_ord").limit(1)
    if strict and not best.count():
        raise ValueError(f"no configuration reaches recall {floor}")
    return best


def grid(table: DataFrame) -> DataFrame:
    """The configurations of a threshold for each stage, without those of one for all."""
    return table.filter(F.col("config").startswith("d"))


def cheapest(table: DataFrame, n: int = 10, floor: float = S.RECALL_FLOOR) -> DataFrame:
    """The n feasible configurations of fewest documents: a top-k report."""
    return feasible(table, floor).orderBy("docs", "config_ord").limit(n)


def pareto(table: DataFrame, floor: float = S.RECALL_FLOOR) -> DataFrame:
    """Feasible configurations with strictly more recall than all cheaper ones.  The table is as small as the sweep."""
    w = Window.orderBy("docs", "config_ord").rowsBetween(Window.unboundedPreceding, -1)
    return feasible(table, floor).withColumn("_before", F.coalesce(F.max("recall").over(w), F.lit(-1.0))).filter("recall > _before").drop("_before")


def false_stops(stops: DataFrame, samples: DataFrame, scores: DataFrame, qrels: DataFrame, cov: DataFrame, retry: float = 0.8) -> DataFrame:
    """A row for each false early stop: its gold, stop, coverage and stages, and whether threshold retry would go on."""
    bad = stops.filter("fes").select("qid", F.col("method").alias("stop_stage"), F.col("cov").alias("coverage_at_stop"))
    gold = qrels.distinct().groupBy("qid").agg(F.sort_array(F.collect_list("doc_id")).alias("gold_docs"))
    stage = samples.join(scores.select("qid", "phase", "p"), ["qid", "phase"]).join(cov.select("qid", "level", "cov"), ["qid", "level"]).join(gold, "qid")
    entry = F.struct("phase", F.struct("k", F.col("ranked").alias("retrieved"), F.array_sort(F.array_intersect("gold_docs", "ranked")).alias("covered_gold"), F.col("cov").alias("coverage"), F.col("p").alias("critic_p")).alias("v"))
    low = lambda m: F.max(F.when(F.col("phase") == m, F.col("p"))) < retry
    stages = stage.groupBy("qid", "question", "gold_docs").agg(F.map_from_entries(F.collect_list(entry)).alias("stages"), (low("dense") & low("hybrid")).alias("would_continue"))
    return bad.join(stages, "qid")


def false_stop_summary(diagnostics: DataFrame) -> DataFrame:
    """(n, min_p, mean_p, max_p, half_share, n_would_continue): probabilities at the stop, and coverages of one half."""
    p = F.expr("stages[stop_stage].critic_p")
    return diagnostics.agg(F.count("*").alias("n"), F.min(p).alias("min_p"), F.avg(p).alias("mean_p"), F.max(p).alias("max_p"), F.coalesce(F.avg((F.abs(F.col("coverage_at_stop") - 0.5) < 1e-9).cast("int")), F.lit(0.0)).alias("half_share"), F.count_if("would_continue").alias("n_would_continue"))


def gap(oracle: DataFrame, critic: DataFrame) -> DataFrame:
    """(recall_gap, full_gap, docs_gap) of two one-row tables with recall, full_rate and docs; missing values are 0."""
    names = ("recall", "full_rate", "docs")
    both = oracle.select(F.lit(1).alias("s"), *names).unionByName(critic.select(F.lit(-1).alias("s"), *names))
    return both.agg(*[F.coalesce(F.sum(F.col("s") * F.col(n)), F.lit(0.0)).alias(f"{n.removesuffix('_rate')}_gap") for n in names])


def leakage(test: DataFrame, *others: DataFrame) -> DataFrame:
    """(n_leaked): questions of test(qid) that any other split has too."""
    seen = others[0].select("qid")
    for more in others[1:]:
        seen = seen.union(more.select("qid"))
    return test.join(seen.distinct(), "qid", "left_semi").agg(F.count("*").alias("n_leaked"))
