"""A corpus pipeline: language, lines, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of their docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from budgetlens.llm import _spark, _tokens, decontamination, language_id, line_dedup, near_dedup, packing

#: Texts whose best language has no more than this share of the score are rejected, as are those without a letter.
LEAST_SCORE = 0.3
WORDS = 5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the others (null or empty text, no letter, no clear language) go.

    Rows with a null or repeated doc_id are judged like others, each by its own text; no rows give no rows.
    """
    names = _spark.free(docs, "language", "score")
    others = tuple(c for c in docs.columns if c != "doc_id")
    told = language_id.predict(docs, language_id.train(docs), keep=others, names=names)
    return told.filter((F.col(names[0]) != language_id.UNKNOWN) & (F.col(names[1]) > LEAST_SCORE)).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats; n_chars follows, and emptied documents go.

    Rows without any line (null, empty, blank) stay; rows whose doc_id is null or repeated lose their own lines only.
    """
    out = line_dedup.without_duplicates(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (runs of five words, similarity 0.8).

    Documents without words and those with a null doc_id stay; rows that repeat a doc_id are documents of their own.
    """
    return near_dedup.without_near_duplicates(docs, words=WORDS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark.  A null text holds none; of repeated rows all go or stay."""
    (hits,) = _spark.free(docs, "hits")
    told = decontamination.flagged(docs, _spark.table(spark, sf_dir, "benchmark"), name=hits)
    return told.filter(F.size(hits) == 0).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in full sequences; a null text counts as empty, repeated rows are packed each."""
    return packing.pack(docs, _tokens.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", by_language),
    ("line dedup", without_repeated_lines),
    ("MinHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmarks),
    ("packing", packed),
]

#: The stages' models and searches are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents."""
    docs = _spark.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, _spark.written(stage(spark, docs, sf_dir))
        _spark.dropped(before)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
