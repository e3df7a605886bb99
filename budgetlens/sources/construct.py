"""Corpora and question sets from raw question-answering rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import files

# Sizes, the seed, and the beginnings of ids.
DOC_TOKENS, KB_DOCS, SEED = 1024, 10_000, 42
SHORT_ROWS, HOP_ROWS = 40_000, 7_405
SHORT_DOC, SHORT_QUESTION, HOP_DOC, HOP_QUESTION = "doc_", "nq_", "hp_", "hotpot_"


def numbered(df: DataFrame, key: str, name: str = "n", size: str | None = None) -> DataFrame:
    """df, written, with ``name``: the place of each row by key, from 1, or the sum of ``size`` over the rows before it.

    Two passes and no task that sees all rows: rows are dealt by ranges of the key and numbered within each range, and
    what the ranges before it hold, one number for each, is added to them.
    """
    ranged = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_id", F.monotonically_increasing_id())
    placed = files.kept(ranged.withColumn("_range", F.shiftright("_id", 33).cast("int")))
    held = F.count("*") if size is None else F.sum(F.coalesce(size, F.lit(0)))
    before, offsets = 0, []
    for r in placed.groupBy("_range").agg(held.cast("bigint").alias("held")).orderBy("_range").collect():  # a row for each range
        offsets.append((r["_range"], before))
        before += r["held"]
    told = placed.join(F.broadcast(placed.sparkSession.createDataFrame(offsets, "_range int, _offset bigint")), "_range")
    if size is None:
        place = F.col("_offset") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    else:
        inside = Window.partitionBy("_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
        place = F.col("_offset") + F.coalesce(F.sum(F.coalesce(size, F.lit(0))).over(inside), F.lit(0))
    return told.withColumn(name, place.cast("bigint")).drop("_id", "_range", "_offset")


def _cut(tokens: Column, start: Column, stop: Column) -> Column:
    return X.stripped(F.array_join(F.slice(tokens, start.cast("int") + 1, (stop - start).cast("int")), " "))


def short_form(rows: DataFrame, ordinal: str, tokens: int = DOC_TOKENS, most_rows: int = SHORT_ROWS, most_docs: int = KB_DOCS) -> tuple[DataFrame, DataFrame]:
    """(docs(doc_id, text), questions(qid, question, answer, gold_docs)) of rows with one document and question each.

    rows have schema SHORT_FORM_ROW and an ordinal from 1, which counts dropped rows too.  Dropped are rows without
    tokens, question or an answer of two characters.  The answer is the first short span of the whole document that is
    not empty, else the first long one.  The scan ends after most_rows rows, or when it has most_docs documents.
    """
    rows = rows.filter(F.col(ordinal) <= most_rows)
    words = F.coalesce("document.tokens.token", F.array().cast("array<string>"))
    head = lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(-1))
    shorts = F.transform("annotations.short_answers", lambda s: F.struct(head(s["start_token"]).alias("a"), head(s["end_token"]).alias("b")))
    short = F.get(F.filter(shorts, lambda s: (s["a"] >= 0) & (s["b"] > s["a"])), F.lit(0))
    long = F.get("annotations.long_answer", F.lit(0))
    base = rows.select(F.col(ordinal).alias("n"), words.alias("w"), F.coalesce("question.text", F.lit("")).alias("question"), short.alias("s"), long.alias("l"))
    first = F.when(F.col("s").isNotNull(), _cut(F.col("w"), F.col("s.a"), F.col("s.b")))
    second = F.when((F.col("l.start_token") >= 0) & (F.col("l.end_token") > F.col("l.start_token")), _cut(F.col("w"), F.col("l.start_token"), F.col("l.end_token")))
    answer = F.coalesce(F.nullif(first, F.lit("")), second, F.lit(""))
    good = base.filter((F.size("w") > 0) & (F.col("question") != "")).withColumn("answer", answer).filter(F.length("answer") >= 2)
    good = good.orderBy("n").limit(most_docs)
    doc_id = X.padded_id(SHORT_DOC, F.col("n"))
    docs = good.select(doc_id.alias("doc_id"), F.array_join(F.slice("w", 1, tokens), " ").alias("text"))
    return docs, good.select(X.padded_id(SHORT_QUESTION, F.col("n")).alias("qid"), "question", "answer", F.array(doc_id).alias("gold_docs"))


def multi_hop(rows: DataFrame, ordinal: str, most_rows: int = HOP_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs(doc_id, text), questions, qrels(qid, doc_id)) of rows whose contexts are several titled documents.

    rows have schema MULTI_HOP_ROW and an ordinal from 1.  A document is gold for its own question if its title is
    among the supporting ones.  Questions without gold are dropped, their documents are not.  Document ids count the
    contexts in order: each question's offset is a running sum of sizes, see numbered().  The scan ends after most_rows rows.
    """
    rows = rows.filter(F.col(ordinal) <= most_rows)
    base = rows.select(F.col(ordinal).alias("_n"), "question", "answer", "type", "supporting_facts", "context")
    sized = base.withColumn("_size", F.coalesce(F.size("context.title"), F.lit(0)))
    placed = numbered(sized, "_n", "_before", "_size")
    each = placed.select("*", F.posexplode("context.title").alias("_i", "title"))
    sentences = F.coalesce(F.get("context.sentences", F.col("_i")), F.array().cast("array<string>"))
    docs = each.select(
        X.padded_id(HOP_QUESTION, F.col("_n")).alias("qid"), X.padded_id(HOP_DOC, F.col("_before") + F.col("_i")).alias("doc_id"),
        F.array_join(sentences, " ").alias("text"), F.array_contains("supporting_facts.title", F.col("title")).alias("gold"),
    )
    qrels = docs.filter("gold").select("qid", "doc_id")
    counts = qrels.groupBy("qid").agg(F.sort_array(F.collect_list("doc_id")).alias("gold_docs"), F.count("*").cast("int").alias("n_supporting"))
    questions = base.select(X.padded_id(HOP_QUESTION, F.col("_n")).alias("qid"), "question", "answer", "type", F.size("supporting_facts.sent_id").alias("n_sent")).join(counts, "qid")
    return docs.select("doc_id", "text"), questions, qrels


def seeded(key: Column, seed: int = SEED) -> Column:
    """A shuffling order that depends on the key and a seed only."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def knowledge_base(docs: DataFrame, qrels: DataFrame, size: int = KB_DOCS, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, is_gold): all gold documents, filled up to size with others in seeded order."""
    gold = docs.join(qrels.select("doc_id").distinct(), "doc_id", "left_semi")
    rest = docs.join(qrels.select("doc_id").distinct(), "doc_id", "left_anti")
    free = max(0, size - gold.count())
    filler = rest.orderBy(seeded(F.col("doc_id"), seed), "doc_id").limit(free)
    return gold.withColumn("is_gold", F.lit(True)).unionByName(filler.withColumn("is_gold", F.lit(False)))


def answerable(questions: DataFrame, qrels: DataFrame, kb: DataFrame) -> DataFrame:
    """Questions all of whose gold documents are in kb."""
    held = qrels.join(kb.select("doc_id", F.lit(1).alias("in_kb")), "doc_id", "left").groupBy("qid").agg(F.bool_and(F.col("in_kb").isNotNull()).alias("all_in"))
    return questions.join(held.filter("all_in"), "qid", "left_semi")


def sample(questions: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    return questions.orderBy(seeded(F.col("qid"), seed), "qid").limit(n)


def splits(questions: DataFrame, sizes: tuple[tuple[str, int], ...] = (("test", 1000), ("train", 5405), ("val", 1000)), seed: int = SEED) -> DataFrame:
    """questions with split: consecutive parts of the seeded order; what is beyond the sizes is left out."""
    total = sum(n for _, n in sizes)
    picked = sample(questions, total, seed).withColumn("_o", seeded(F.col("qid"), seed))
    numbered = picked.withColumn("_n", F.row_number().over(Window.orderBy("_o", "qid")))  # as many rows as the sizes say
    split, upto = None, 0
    for name, n in sizes:
        upto += n
        split = F.when(F.col("_n") <= upto, name) if split is None else split.when(F.col("_n") <= upto, name)
    return numbered.withColumn("split", split).drop("_o", "_n")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, in any order, as often."""
    b = b.select(*a.columns)
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()
