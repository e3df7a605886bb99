"""Sufficiency critic: samples, training, inference and early stopping by its probability."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..sources import files

DOC_WORDS = 48
FEATURES = ("term_share", "log_words", "k")


def samples(questions: DataFrame, runs: DataFrame, docs: DataFrame, cov: DataFrame, words: int = DOC_WORDS) -> DataFrame:
    """(qid, question, phase, level, k, docs, label, ranked) for each question with gold and stage of cov's ladder.

    docs joins the first words of each document of the cut list in order of rank; label is full coverage.
    """
    stages = cov.select("qid", "level", "method", "k", "full")
    cut = files.kept(stages.join(runs, ["qid", "method"]).filter(F.col("rank") <= F.col("k")).select("qid", "level", "rank", "doc_id"))
    listed = cut.join(_heads(docs, cut, words), "doc_id")
    lists = listed.groupBy("qid", "level").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "w"))).alias("l"))
    out = stages.join(lists, ["qid", "level"], "left").join(questions.select("qid", "question"), "qid")
    none = F.array()
    return out.select(
        "qid", "question", F.col("method").alias("phase"), "level", "k", F.array_join(F.coalesce(F.transform("l", lambda x: x["w"]), none.cast("array<string>")), " ").alias("docs"),
        F.col("full").cast("int").alias("label"), F.coalesce(F.transform("l", lambda x: x["doc_id"]), none.cast("array<bigint>")).alias("ranked"),
    )


def _heads(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(doc_id, w): the first words of the documents in asked."""
    return files.picked(docs.select("doc_id", "text"), asked).select("doc_id", X.first_words(F.col("text"), words).alias("w"))


def inputs(questions: DataFrame, lists: DataFrame, docs: DataFrame, phase: str, level: int, k: int, words: int = DOC_WORDS) -> DataFrame:
    """(qid, question, phase, level, k, docs) of one stage: what the critic reads of lists(qid, doc_id, rank)."""
    listed = lists.join(_heads(docs, lists, words), "doc_id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "w"))).alias("l"))
    said = F.array_join(F.coalesce(F.transform("l", lambda x: x["w"]), F.array().cast("array<string>")), " ")
    return questions.select("qid", "question").join(listed, "qid", "left").select("qid", "question", F.lit(phase).alias("phase"), F.lit(level).alias("level"), F.lit(k).alias("k"), said.alias("docs"))


def usable(rows: DataFrame) -> DataFrame:
    """Samples whose documents have words; what training takes."""
    return rows.filter(F.trim("docs") != "")


def pair_text(rows: DataFrame) -> DataFrame:
    """rows with input: question and documents as a classifier reads them."""
    return rows.withColumn("input", F.concat_ws(" [SEP] ", "question", "docs"))


def term_share(rows: DataFrame) -> DataFrame:
    """rows with term_share: the share of the question's distinct tokens among those of the documents, 0 without any."""
    asked = F.array_distinct(X.tokens(F.col("question")))
    met = F.array_intersect(asked, X.tokens(F.col("docs")))
    return rows.withColumn("term_share", X.ratio(F.size(met), F.size(asked)))


def lexical_score(rows: DataFrame) -> DataFrame:
    """rows with p, the deterministic critic: term share with some noise from a hash of question and level."""
    noise = (X.hash16(F.concat_ws(":", "qid", F.col("level").cast("string"))) % 1000).cast("double") / F.lit(999.0)
    return term_share(rows).withColumn("p", F.lit(0.7).cast("double") * F.col("term_share") + F.lit(0.3).cast("double") * noise).drop("term_share")


def features(rows: DataFrame) -> DataFrame:
    return term_share(rows).withColumn("log_words", F.log1p(X.word_count(F.col("docs")).cast("double"))).withColumn("k", F.col("k").cast("double"))


def train(train_rows: DataFrame, val_rows: DataFrame, penalties: tuple[float, ...] = (0.0, 0.01, 0.1)):
    """The logistic model of the largest validation F1 over penalties (the first on ties), with that F1."""
    best, best_f1 = None, -1.0
    for penalty in penalties:
        stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="features"), LogisticRegression(regParam=penalty, labelCol="label")]
        model = Pipeline(stages=stages).fit(features(usable(train_rows)))
        p = F.col("p") >= 0.5
        yes = F.col("label") == 1
        n = scored(model, val_rows).agg(F.count_if(p & yes).alias("tp"), F.count_if(p | yes).alias("any")).first()
        f1 = 2 * n["tp"] / (n["any"] + n["tp"]) if n["any"] + n["tp"] else 0.0
        if f1 > best_f1:
            best, best_f1 = model, f1
    return best, best_f1


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def scored(model, rows: DataFrame) -> DataFrame:
    """rows with p from a model of train()."""
    return model.transform(features(rows)).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", *FEATURES[:2])


def early_stop(cov: DataFrame, scores: DataFrame, configs: DataFrame, latencies: DataFrame, critic_ms: float = S.CRITIC_MS) -> DataFrame:
    """(config, qid, level, method, k, cov, full, ms, fes) where each configuration of thresholds stops each question.

    cov has the three stages of a ladder, scores(qid, phase, p).  A question stops at the first stage whose probability
    reaches the stage's threshold, else at the last; the critic runs at every stage up to it.  fes: stopped before the
    last stage without full coverage.
    """
    wide = scores.groupBy("qid").agg(*[F.max(F.when(F.col("phase") == m, F.col("p"))).alias(f"p_{m}") for m in ("dense", "hybrid")])
    each = wide.withColumn("c", F.explode(F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in configs.columns]) for r in configs.orderBy("config_ord").collect()])))
    level = F.when(F.col("p_dense") >= F.col("c.t_dense"), 1).when(F.col("p_hybrid") >= F.col("c.t_hybrid"), 2).otherwise(3)
    stops = each.select("qid", "c.config_ord", "c.config", "c.t_dense", "c.t_hybrid", level.alias("level"))
    out = stops.join(cov.select("qid", "level", "method", "k", "cov", "full"), ["qid", "level"]).join(F.broadcast(latencies), "method")
    return out.withColumn("ms", F.col("ms") + F.lit(float(critic_ms)) * F.col("level")).withColumn("fes", (F.col("level") < 3) & ~F.col("full"))
