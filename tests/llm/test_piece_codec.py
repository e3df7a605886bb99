import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from budgetlens.llm import _tokens
from budgetlens.llm import piece_codec as P
from tests.llm.helpers import ODD, clashing, corpus, documents

PATH = _tokens.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    return P.Pieces(PATH)


def texts(seed=4, n=400):
    rng = random.Random(seed)
    mixed = ["".join(rng.choices("abcdeéß ▁\n\t漢字😀 the  \x00\x1c '’.,0123", k=rng.randint(1, 60))) for _ in range(n)]
    letters = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 900))) for _ in range(n // 10)]
    any_code = ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return mixed + letters + any_code + corpus(seed) + [t for t in ODD if t] + ["", " ", "   ", "▁", "▁▁x ▁", " " * 700, "ab" * 3000, "�﻿"]


@pytest.mark.parametrize("long", [P.LONG, 4])
def test_ids_equal_the_librarys_by_rounds_and_by_heap(library, pieces, monkeypatch, long):
    monkeypatch.setattr(P, "LONG", long)
    pieces.parts.new.clear(), pieces.marked.new.clear()
    all_texts = texts()
    for text, ids in zip(all_texts, pieces.encode(all_texts)):
        assert ids.tolist() == library.encode(text), repr(text[:80])


def test_a_memo_and_small_rounds_change_nothing(library, pieces, monkeypatch):
    monkeypatch.setattr(P, "MEMO", 5)
    monkeypatch.setattr(P, "ROUND_CHARS", 50)
    pieces.parts.new.clear(), pieces.marked.new.clear()
    for text in texts(9, 60):
        assert pieces.encode([text])[0].tolist() == library.encode(text)


def test_any_ids_decode_as_the_library_has_them(library, pieces):
    rng = random.Random(6)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 259, 29871]) for _ in range(rng.randint(0, 9))]
        assert pieces.decode(np.array(ids, np.int64)) == library.decode(ids)
    with pytest.raises(ValueError):
        pieces.decode(np.array([32000]))


def test_frames_round_trip_with_the_librarys_digests(spark, library):
    all_texts = texts(2, 60) + [None]
    coded = P.decode(P.encode(documents(spark, all_texts).repartition(3), PATH), PATH)
    rows = coded.withColumn("listed", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)).collect()
    assert len(rows) == len(all_texts)
    for r in rows:
        ids = library.encode(all_texts[r["doc_id"]] or "", add_eos=True)
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)
        assert r["listed"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_null_keys_repeated_rows_empty_table_null_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "same"), (None, "same"), (1, None)], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in P.encode(df, PATH).collect()) == [(0, 2), (0, 2), (1, 1)]
    assert P.encode(df.limit(0), PATH).count() == 0 and P.decode(P.encode(df.limit(0), PATH), PATH).count() == 0
    out = P.decode(P.encode(clashing(spark, ["a b"], ["ids", "decoded", "_ids"]), PATH), PATH)
    assert sorted(out.columns) == ["_ids", "decoded", "doc_id", "ids", "text"] and out.first()["decoded"] == "a b"
    assert P.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), PATH).select("decoded").collect() == [(None,), ("",)]
    with pytest.raises(Exception, match="null"):
        P.decode(spark.createDataFrame([([1, None],)], "ids array<int>"), PATH).collect()


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    other = tmp_path / "other.model"
    other.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        P.Pieces(str(other))
