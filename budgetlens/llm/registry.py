"""The subpackage's queries, under their names in __spark_entry__.py, and their SQL."""

from __future__ import annotations

from . import decontamination, exact_dedup, hard_negatives, language_id, line_dedup, near_dedup, packing, piece_codec, pii, sharding, spelling, token_counts, url_filter


def queries():
    return {
        "op1_simhash_decontamination": decontamination.op1_simhash_decontamination,
        "op2_weak_pii": pii.op2_weak_pii,
        "op3_chosen_path_dedup": near_dedup.op3_chosen_path_dedup,
        "op4_hierarchical_packing": packing.op4_hierarchical_packing,
        "op5_language_nb": language_id.op5_language_nb,
        "op6_url_markov": url_filter.op6_url_markov,
        "op7_chunk_recipes": exact_dedup.op7_chunk_recipes,
        "op8_minhash_lines": line_dedup.op8_minhash_lines,
        "op9_rendezvous_shards": sharding.op9_rendezvous_shards,
        "op10_edit_aware_counts": token_counts.op10_edit_aware_counts,
        "op11_vantage_negatives": hard_negatives.op11_vantage_negatives,
        "op12_trie_variants": spelling.op12_trie_variants,
        "op13_sentencepiece_rounds": piece_codec.op13_sentencepiece_rounds,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_simhash_decontamination": decontamination.OP1_SQL,
        "op3_chosen_path_dedup": near_dedup.OP3_SQL,
        "op7_chunk_recipes": exact_dedup.OP7_SQL,
        "op8_minhash_lines": line_dedup.OP8_SQL,
        "op9_rendezvous_shards": sharding.op9_sql(),
        "op11_vantage_negatives": hard_negatives.OP11_SQL,
        "op12_trie_variants": spelling.OP12_SQL,
    }
