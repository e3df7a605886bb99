import pytest

from budgetlens.llm import registry
from tests.oracle import agree


def test_names_and_kinds():
    assert len(registry.queries()) == 13 and all(map(callable, registry.queries().values()))
    assert set(registry.oracle_sql()) <= set(registry.queries()) and all(isinstance(s, str) for s in registry.oracle_sql().values())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_its_sql(spark, data, name):
    agree(registry.queries()[name], registry.oracle_sql()[name], spark, data)


@pytest.mark.parametrize("name", sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0])))
def test_contracts_columns(spark, data, name):
    want = {
        2: "doc_id n_email n_ip n_card n_phone base_sha256 spans", 3: "doc_id n_shingles component_id kept", 4: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        5: "doc_id held_out lang_pred score", 6: "page_id host path rule verdict", 7: "doc_id keep_id group_size kept text_sha256", 9: "doc_id size text_crc32 law shard slot grown_shard",
        11: "anchor_id positive_id rank negative_id positive_score negative_score", 12: "word form root n n_near form_n", 13: "doc_id n_tokens ids_sha256 decoded_sha256",
    }.get(int(name[2:].split("_")[0]), "doc_id")
    out = registry.queries()[name](spark, data)
    kinds = dict(out.dtypes)
    assert set(want.split()) <= set(kinds)
    for n in ("n_tokens", "negative_score", "form_n", "n_near", "n_email", "n_shingles", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "group_size", "size", "text_crc32", "slot"):
        assert kinds.get(n, "bigint") == "bigint"
