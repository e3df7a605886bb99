"""The fact table of all experiments: how much of each question's gold each strategy finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(runs: DataFrame, qrels: DataFrame, strategies: DataFrame) -> DataFrame:
    """(qid, level, name, method, k, n_hit, n_gold, n_docs, cov, full) for each question with gold and strategy.

    runs(method, qid, doc_id, rank), qrels(qid, doc_id), strategies(level, name, method, k).  Questions without any
    hit, and strategies without a list for a question, have n_hit 0.  n_docs is the length of the cut list.
    """
    gold = qrels.distinct()
    golds = gold.groupBy("qid").agg(F.count("*").alias("n_gold"))
    top = F.broadcast(strategies)  # a constant relation
    cut = runs.join(top, "method").filter(F.col("rank") <= F.col("k")).select("qid", "level", "doc_id")
    marked = cut.join(gold.withColumn("hit", F.lit(1)), ["qid", "doc_id"], "left")
    hits = marked.groupBy("qid", "level").agg(F.count("hit").alias("n_hit"), F.count("*").alias("n_docs"))
    every = golds.withColumn("s", F.explode(F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("level", "name", "method", "k")]) for r in strategies.orderBy("level").collect()])))
    out = every.select("qid", "n_gold", "s.*").join(hits, ["qid", "level"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select("qid", "level", "name", "method", "k", n_hit.alias("n_hit"), "n_gold", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"), (n_hit / F.col("n_gold")).alias("cov"), (n_hit == F.col("n_gold")).alias("full"))


def chosen(facts: DataFrame, rows: tuple[tuple[str, str, int], ...]) -> DataFrame:
    """coverage() of some strategies (name, method, k) from facts that hold all their methods and cuts, without a join."""
    s = F.explode(F.filter(F.array(*[F.struct(F.lit(i + 1).alias("level"), F.lit(n).alias("name"), F.lit(m).alias("m"), F.lit(k).alias("c")) for i, (n, m, k) in enumerate(rows)]), lambda s: (s["m"] == F.col("method")) & (s["c"] == F.col("k"))))
    others = [c for c in facts.columns if c not in ("qid", "method", "k")]
    return facts.withColumn("_s", s).select("qid", "_s.level", "_s.name", "method", "k", *others)


def best_ranks(runs: DataFrame, qrels: DataFrame, methods: tuple[str, ...] = ("dense", "hybrid", "rerank")) -> DataFrame:
    """(qid, doc_id, best): the best rank of each gold document over methods, null where no list has it."""
    mine = runs.filter(F.col("method").isin(*methods)).groupBy("qid", "doc_id").agg(F.min("rank").alias("best"))
    return qrels.distinct().join(mine, ["qid", "doc_id"], "left")


def difficulty(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, difficulty): easy if every gold document is in a top 3, medium if in a top 10, else hard."""
    within = lambda k: F.bool_and(F.coalesce(F.col("best") <= k, F.lit(False)))
    return best_ranks(runs, qrels).groupBy("qid").agg(F.when(within(3), "easy").when(within(10), "medium").otherwise("hard").alias("difficulty"))
