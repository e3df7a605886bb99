"""Choosing a strategy for each question: oracle, routers, ladders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X


def oracle_pick(cov: DataFrame) -> DataFrame:
    """The cheapest strategy of full coverage for each question, else the cheapest of the largest coverage."""
    w = Window.partitionBy("qid").orderBy(F.desc("full"), F.desc("cov"), "level")
    return cov.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def oracle_summary(cov: DataFrame, *groups: str) -> DataFrame:
    return oracle_pick(cov).groupBy(*groups).agg(F.count("*").alias("n_queries"), F.avg("cov").alias("best_recall"), F.avg(F.when(F.col("full"), 1.0).otherwise(0.0)).alias("full_rate"), F.avg("level").alias("mean_level"), F.avg("k").alias("mean_docs"))


def ladder_stop(cov: DataFrame) -> DataFrame:
    """The first strategy of full coverage for each question of a ladder's coverage, else the last one."""
    full, last = F.min(F.when(F.col("full"), F.col("level"))), F.max("level")
    stops = cov.groupBy("qid").agg(F.coalesce(full, last).alias("level"))
    return cov.join(stops, ["qid", "level"])


def ladder_summary(stops: DataFrame, latencies: DataFrame, *groups: str) -> DataFrame:
    """(groups, n_queries, recall, full_rate, mean_docs, mean_level, never_sufficient, mean_ms); a stage is priced by its method."""
    priced = stops.join(F.broadcast(latencies), "method")  # a constant relation
    return priced.groupBy(*groups).agg(
        F.count("*").alias("n_queries"), F.avg("cov").alias("recall"), F.avg(F.col("full").cast("int")).alias("full_rate"), F.avg("k").alias("mean_docs"),
        F.avg("level").alias("mean_level"), F.count_if(F.col("cov") < 1).alias("never_sufficient"), F.avg("ms").alias("mean_ms"),
    )


def stage_distribution(stops: DataFrame, strategies: DataFrame) -> DataFrame:
    """(level, name, n, share) for each stage of a ladder, zero where none stops."""
    counts = stops.groupBy("level").agg(F.count("*").alias("n"))
    out = F.broadcast(strategies).join(counts, "level", "left").select("level", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return out.withColumn("share", X.ratio(F.col("n"), F.sum("n").over(Window.partitionBy())))


def rule_label(question: Column) -> Column:
    """Difficulty by the question's words alone."""
    low, n = F.lower(question), X.word_count(question)
    several = (n >= 10) & X.contains_any(low, X.CONJUNCTIONS) & (X.entity_count(question) >= 2)
    return F.when(n >= 18, "hard").when(X.contains_any(low, X.COMPARISON), "medium").when(several, "medium").otherwise("easy")


#: Prompts to answers.
Chat = Callable[[pd.Series], pd.Series]


def model_label(questions: DataFrame, chat: Callable[[], Chat]) -> DataFrame:
    """(qid, answer, label, parsed) of questions(qid, question), from a chat model that chat() makes once for each task."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = chat()
        for prompts in batches:
            yield model(prompts)

    told = questions.select("qid", ask(X.prompt(F.col("question"))).alias("answer"))
    return told.select("qid", "answer", X.label_or_easy(F.col("answer")).alias("label"), X.parsed_label(F.col("answer")).isNotNull().alias("parsed"))


def routed(cov: DataFrame, labels: DataFrame, routes: dict[str, str] = S.ROUTES) -> DataFrame:
    """The coverage rows that labels(qid, label) choose; a question without a label is easy."""
    route = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])
    told = cov.join(labels.select("qid", "label"), "qid", "left").withColumn("label", F.coalesce("label", F.lit("easy")))
    return told.filter(F.col("name") == F.get(F.array(F.element_at(route, F.col("label"))), F.lit(0))).drop("label")


def cut_recalls(picks: DataFrame, runs: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = S.KS) -> DataFrame:
    """picks(system, qid, method, k, ...) with r<K>: recall of the first K of the list that was picked, itself cut at k."""
    gold = qrels.distinct()
    golds = gold.groupBy("qid").agg(F.count("*").alias("_gold"))
    hits = picks.select("system", "qid", "method", "k").join(runs.select("method", "qid", "doc_id", "rank"), ["method", "qid"]).filter("rank <= k").join(gold, ["qid", "doc_id"], "left_semi")
    sums = hits.groupBy("system", "qid").agg(*[F.count_if(F.col("rank") <= n).alias(f"_h{n}") for n in ks])
    out = picks.join(golds, "qid").join(sums, ["system", "qid"], "left")
    return out.select(*picks.columns, *[(F.coalesce(f"_h{n}", F.lit(0)) / F.col("_gold")).alias(f"r{n}") for n in ks])


def systems(cov: DataFrame, labels: dict[str, DataFrame]) -> DataFrame:
    """Picks of all systems with a column system: the fixed ones, a router for each entry of labels, the oracle."""
    out = cov.filter(F.col("name").isin(*S.FIXED)).withColumn("system", F.col("name"))
    for name, told in labels.items():
        out = out.unionByName(routed(cov, told).withColumn("system", F.lit(name)))
    return out.unionByName(oracle_pick(cov).withColumn("system", F.lit("oracle")))


def system_table(cov: DataFrame, labels: dict[str, DataFrame], runs: DataFrame, qrels: DataFrame, truth: DataFrame, ks: tuple[int, ...] = S.KS) -> DataFrame:
    """(system, n_queries, r<K>..., mean_docs, mean_level, accuracy); documents are those that a list really has.

    accuracy, against truth(qid, difficulty), is a router's; it is null for the other systems.
    """
    both = cut_recalls(systems(cov, labels), runs, qrels, ks)
    out = both.groupBy("system").agg(F.count("*").alias("n_queries"), *[F.avg(f"r{k}").alias(f"r{k}") for k in ks], F.avg("n_docs").alias("mean_docs"), F.avg("level").alias("mean_level"))
    told = [router_accuracy(rows, truth).select(F.lit(name).alias("system"), "accuracy") for name, rows in labels.items()]
    accuracy = reduce(DataFrame.union, told, cov.sparkSession.createDataFrame([], "system string, accuracy double"))
    return out.join(accuracy, "system", "left")


def router_accuracy(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """(n_queries, accuracy) of labels(qid, label) against truth(qid, difficulty)."""
    both = truth.join(labels, "qid", "left")
    return both.agg(F.count("*").alias("n_queries"), F.avg((F.coalesce("label", F.lit("easy")) == F.col("difficulty")).cast("int")).alias("accuracy"))
