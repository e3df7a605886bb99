from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline as P
from budgetlens.llm import _spark, decontamination, line_dedup, near_dedup
from tests.llm.helpers import clashing, corpus
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_line_dedup import brute as line_groups
from tests.llm.test_near_dedup import brute as near_groups

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], COLUMNS)


def test_stages_and_names():
    assert [n for n, _ in P.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]
    assert "pipeline" in entry_point.queries() and P.ORACLE_SQL is None
    names = [n for n in entry_point.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_stages_keep_the_columns_and_take_effect(spark, data):
    docs = _spark.table(spark, data, "documents")
    seen = [docs.count()]
    for _, stage in P.STAGES[:-1]:
        out = _spark.written(stage(spark, docs, data))
        assert out.columns == docs.columns
        docs = out
        seen.append(docs.count())
    assert seen[0] >= seen[1] > seen[2] >= seen[3] and seen[4] > 0
    assert P.packed(spark, docs, data).select("doc_id").distinct().count() == seen[4]


def test_stages_equal_brute_force(spark, tmp_path):
    texts = corpus(7, 60, 4, "abcdefgh") + ["", None, "12 34"]
    held = texts[:40] + ["Some new words. " + " ".join(texts[45].split()[:14]) + " and the end of it."]
    spark.createDataFrame([(0, " ".join(texts[45].split()[:14]))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    kept = ids(P.by_language(spark, docs_of(spark, texts), str(tmp_path)))
    assert kept == {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    lines = {r["doc_id"]: r for r in P.without_repeated_lines(spark, docs_of(spark, texts), str(tmp_path)).collect()}
    groups = line_groups(texts)
    for i, t in enumerate(texts):
        rest = [x for n, x in enumerate((t or "").split("\n")) if groups.get((i, n), (i, n)) == (i, n)]
        if rest or not t:
            assert lines[i]["text"] == (t if t is None else "\n".join(rest)) and lines[i]["n_chars"] in (None, len("\n".join(rest)))
        else:
            assert i not in lines
    bags, _ = near_groups(texts)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(spark, texts), words=P.WORDS).collect()}
    assert ids(P.without_near_duplicates(spark, docs_of(spark, texts), str(tmp_path))) == {d for d, c in found.items() if d == c} and bags
    clean = ids(P.without_benchmarks(spark, docs_of(spark, held), str(tmp_path)))
    assert clean == set(range(len(held))) - {d for d, _ in leaks(held, [" ".join(texts[45].split()[:14])])} and 40 not in clean


def test_run_and_empty_input(spark, data, tmp_path):
    assert P.run(spark, data).count() > 0
    _spark.table(spark, data, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    _spark.table(spark, data, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark, data):
    docs = clashing(spark, ["The words of a text.\nThe words of a text.", None], ["kept", "_hits_", "id", "component_id", "line"])
    for _, stage in P.STAGES[1:4]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.count() == 2
    more = clashing(spark, ["The words of a text. The words of a text.", None], ["language", "score", "_language", "lang", "sequence_id", "length"])
    told = P.by_language(spark, more, data)
    assert told.columns == more.columns and told.count() <= 1
    assert P.packed(spark, more, data).select("doc_id").distinct().count() == 2
    assert line_dedup and decontamination


def test_rows_that_share_a_key_keep_every_text_of_their_own(spark, data):
    """No stage loses a text because another row has its key; null keys pass."""
    own = ["The first words of a long text that stands nowhere else.", "Some other words of a text, which no other row repeats.", "Words without any key, in a sentence of their own."]
    rows = [(1, own[0]), (7, own[0]), (7, own[1]), (None, own[2]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in P.without_near_duplicates(spark, docs, data).collect())
    assert got == [(0, ""), (0, own[2]), (1, own[0]), (7, own[1])]
    for stage in (P.by_language, P.without_repeated_lines, P.without_benchmarks):
        assert {own[0], own[1], own[2]} <= {r["text"] for r in stage(spark, docs.withColumn("lang", F.lit("en")), data).collect()}
    assert P.packed(spark, docs, data).count() >= 5
