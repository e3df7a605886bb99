import pytest

import __spark_entry__ as entry_point
from budgetlens.plans.oracle import ORACLE
from budgetlens.plans.queries import QUERIES
from tests.oracle import agree


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_its_sql(spark, data, name):
    agree(QUERIES[name], ORACLE[name], spark, data)


def test_queries_and_sql_are_registered():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLE) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert rows and {"dataset", "method", "k", "recall"} <= set(rows[0].asDict())


def test_recall_never_falls_with_k_and_rerank_keeps_the_pool(spark, data):
    rows = {(r["dataset"], r["method"], r["k"]): r["recall"] for r in QUERIES["recall_matrix"](spark, data).collect()}
    for (dataset, method, k), recall in rows.items():
        assert all(recall <= rows[dataset, method, other] for other in (3, 5, 10, 20) if other > k)
    assert all(rows[d, "rerank", 20] == rows[d, "hybrid", 20] for d, m, k in rows if m == "rerank")


def test_trained_critic_scores_every_sample_of_the_test_half(spark):
    rows = QUERIES["critic_ml"](spark, "/root/testdata/sf0.01").collect()
    assert rows and all(0 <= r["p"] <= 1 for r in rows)
