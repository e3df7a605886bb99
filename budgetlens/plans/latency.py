"""Wall-clock times of retrieval stages."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def measured(spark: SparkSession, stages: dict[str, Callable[[], DataFrame]], repeats: int = 5) -> DataFrame:
    """(stage, run, ms): each stage is planned and run to its last row, repeats times.

    A stage is a search for a whole set of questions; divide by their number for a time per question.  Summaries come
    from metrics.latency_summary().
    """
    rows = []
    for name, stage in stages.items():
        for run in range(repeats):
            begun = time.perf_counter()
            stage().write.format("noop").mode("overwrite").save()
            rows.append((name, run, (time.perf_counter() - begun) * 1000))
    return spark.createDataFrame(rows, "stage string, run int, ms double")


def per_question(questions: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], most: int = 200) -> DataFrame:
    """(stage, qid, ms): each of the first ``most`` of questions(qid, ...), by qid, is searched for alone by each stage."""
    spark, rows = questions.sparkSession, []
    for r in questions.orderBy("qid").take(most):
        one = spark.createDataFrame([r], questions.schema)
        for name, stage in stages.items():
            begun = time.perf_counter()
            stage(one).write.format("noop").mode("overwrite").save()
            rows.append((name, r["qid"], (time.perf_counter() - begun) * 1000))
    return spark.createDataFrame(rows, "stage string, qid string, ms double")


def observed(spark: SparkSession, stages: dict[str, Callable[[], DataFrame]], n_questions: int) -> DataFrame:
    """(stage, n_questions, n_answered, n_rows, mean_rank, ms): each stage runs once for all questions.

    What it returns is observed while it runs, so nothing runs twice; ms is the wall clock of planning and running.
    """
    rows = []
    for name, stage in stages.items():
        begun, seen = time.perf_counter(), Observation(name)
        told = stage().observe(seen, F.count(F.lit(1)).alias("n_rows"), F.sum((F.col("rank") == 1).cast("long")).alias("n_answered"), F.avg("rank").alias("mean_rank"))
        told.write.format("noop").mode("overwrite").save()
        ms, got = (time.perf_counter() - begun) * 1000, seen.get
        rows.append((name, n_questions, got["n_answered"] or 0, got["n_rows"], got["mean_rank"], ms))
    return spark.createDataFrame(rows, "stage string, n_questions bigint, n_answered bigint, n_rows bigint, mean_rank double, ms double")
