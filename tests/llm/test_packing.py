import random
import struct
import zlib

import pytest
from tokenizers import Tokenizer

from budgetlens.llm import _tokens, packing
from tests.llm.helpers import ODD, clashing, corpus, documents

PATH = _tokens.vocabulary("word_bpe_49k.json")


def test_word_memo_equals_the_tokenizer():
    rng, own, plain = random.Random(2), _tokens.WordEncoder(PATH), Tokenizer.from_file(PATH)
    texts = ["".join(rng.choices(list("aBé ß.,'s\x1c İΣσ\u0301ǰJ\u030c한가9!$\n\x85\u2028"), k=rng.randint(0, 40))) for _ in range(5000)]
    for t in [*texts, *corpus(1, 20), *[o for o in ODD if o], "<|endoftext|> x<|endoftext|>y"]:
        ids = plain.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == struct.pack(f"<{len(ids)}I", *ids), ascii(t)


@pytest.mark.parametrize("round_tokens", [1, 3000, 1 << 20])
def test_pieces_cover_documents_and_fill_sequences(spark, round_tokens):
    texts = corpus(4, 80) + ODD
    rows = packing.pack(documents(spark, texts).repartition(3), PATH, round_tokens=round_tokens).collect()
    plain = Tokenizer.from_file(PATH)
    by_doc, by_seq, by_step = {}, {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        by_step.setdefault(r["step_id"], set()).add((r["sequence_id"], r["window"]))
    assert set(by_doc) == set(range(len(texts)))
    for d, pieces in by_doc.items():
        ids = plain.encode(texts[d] or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            own = ids[at : at + p["length"]]
            assert p["start"] == at and p["length"] == len(own) > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += p["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == pieces[0]["window"] <= 2048 and at & (at - 1) == 0
    assert all(sum(w for _, w in s) <= max(packing.STEP_TOKENS, 2048) and len({w for _, w in s}) == 1 for s in by_step.values())


def test_windows_take_whole_pieces_before_they_cut():
    full, left = packing.fill([(1500, 0, 0), (500, 1, 0), (48, 2, 0), (200, 3, 0), (56, 4, 0)], packing.WINDOWS)
    assert [(w, sorted(p[1] for p in c)) for w, c in full] == [(2048, [0, 1, 2]), (256, [3, 4])] and left == []
    assert packing.close([(5, 0, 0), (6, 1, 0)]) == [(8, [(5, 0, 0), (3, 1, 0)]), (2, [(2, 1, 3)]), (1, [(1, 1, 5)])]


def test_repeated_rows_empty_table_and_clashing_columns(spark):
    rows = packing.pack(documents(spark, ["one two", "one two", None], [5, 5, None]), PATH).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in rows)[-1] == (True, 1)
    assert sum(r["length"] for r in rows) == 3 + 3 + 1
    assert packing.pack(documents(spark, ["x"]).limit(0), PATH).count() == 0
    assert packing.pack(clashing(spark, ["x y"], ["start", "length", "window"]), PATH).count() >= 1
    with pytest.raises(ValueError):
        packing.pack(documents(spark, ["x"]), PATH, windows=(300, 2048))
