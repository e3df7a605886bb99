"""Reciprocal-rank fusion and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files
from .dense import ranked

# Fusion constant, length of the fused lists, length of the result.
RRF_K, POOL, TOP = 60, 200, 20


def rrf(lists: list[DataFrame], k: int = RRF_K, pool: int = POOL, top: int = TOP) -> DataFrame:
    """(qid, doc_id, rank, score) from lists(qid, doc_id, rank): sums of 1 / (k + rank) over each list's first pool."""
    joined = None
    for one in lists:
        part = one.filter(F.col("rank") <= pool).select("qid", "doc_id", (1.0 / (k + F.col("rank"))).alias("part"))
        joined = part if joined is None else joined.unionByName(part)
    return ranked(joined.groupBy("qid", "doc_id").agg(F.sum("part").alias("score")), top, F.desc("score"), "doc_id").select("qid", "doc_id", "rank", "score")


def pair_share(question: Column, text: Column) -> Column:
    """Share of the question's adjacent word pairs that the text contains, both lower-cased; 0 without a pair."""
    words = F.split(F.lower(question), " ")
    n = F.size(words) - 1
    pairs = F.transform(F.slice(words, 1, F.greatest(n, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.when(n > 0, F.size(F.filter(pairs, lambda p: F.contains(F.lower(text), p))) / n).otherwise(0.0)


#: (questions, texts) to scores.
Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def scored_by(model: Callable[[], Scorer]):
    """A column function (question, text) from a model of pairs that model() makes once for each task."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = model()
        for questions, texts in batches:
            yield own(questions, texts)

    return score


def rerank(pool: DataFrame, queries: DataFrame, docs: DataFrame, score=pair_share, top: int = TOP) -> DataFrame:
    """(qid, doc_id, rank, score): the pool(qid, doc_id, rank) of each query by score(question, text), ties by its rank."""
    pool = files.kept(pool.select("qid", "doc_id", F.col("rank").alias("before")))
    pairs = pool.join(queries.select("qid", "question"), "qid").join(files.picked(docs.select("doc_id", "text"), pool), "doc_id")
    return ranked(pairs.withColumn("score", score(F.col("question"), F.col("text"))), top, F.desc("score"), "before").select("qid", "doc_id", "rank", "score")
