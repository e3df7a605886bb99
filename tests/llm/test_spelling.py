import random
import re
import zlib
from collections import Counter

import pytest

from budgetlens.llm import spelling as S
from tests.llm.helpers import ODD, clashing, corpus, documents


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rows, least_length=7, least_count=2):
    counts = Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def plain(counts, times=10):
    form, rows = {}, {}
    for w, n in counts.items():
        close = [o for o in counts if o != w and near(w, o)]
        best = min(close, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
        rows[w] = len(close)
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, rows[w], form[w], counts[form[w]] if form[w] else None, root))
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def some_words(seed, n, alphabet="abcé", most=7):
    rng = random.Random(seed)
    return {"".join(rng.choices(alphabet, k=rng.randint(0, most))): int(10 ** rng.uniform(0, 5)) for _ in range(n)}


@pytest.mark.parametrize("seed", range(40))
def test_a_subtree_joins_itself_like_brute_force(seed):
    words = sorted(some_words(seed, random.Random(seed).randint(0, 90), "abcé"[: 1 + seed % 4]))
    want = [(a, b) for a in range(len(words)) for b in range(a + 1, len(words)) if near(words[a], words[b])]
    assert sorted(tuple(sorted(p)) for p in S.subtree_pairs(words)) == want


@pytest.mark.parametrize("node", [2, 20, 10_000])
def test_partitions_of_any_size_find_each_pair_once(spark, node):
    counts = some_words(7, 160)
    rows = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in S.near_pairs(rows, node).collect()]
    words = sorted(counts)
    assert sorted(pairs) == [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)]


def test_forms_and_roots_follow_chains_and_ties_go_to_the_smallest(spark):
    counts = some_words(11, 150) | {"aaaaaaaa": 1, "aaaaaaab": 20, "aaaaaabb": 400, "aaaaabbb": 8000, "aaaabbbb": 900_000, "zzzz": 1, "zzzé": 50, "zzzy": 50}
    got = told(S.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint"), node=16))
    assert got == plain(counts)
    by = {r[0]: r for r in got}
    assert by["aaaaaaaa"][5] == "aaaabbbb" and by["zzzz"][3] == "zzzy"


def test_words_of_texts_and_their_variants_equal_a_plain_model(spark):
    texts = corpus(5, 60, 3) * 2 + ODD + ["Wörterbuch WÖRTERBUCH wörterbuch. encyclopedia ENCYCLOPEDIA encyclopaedia " * 40]
    counts = words_of(list(enumerate(texts)), 3)
    vocabulary = S.vocabulary(documents(spark, texts).repartition(3), least_length=3)
    assert {r["word"]: r["n"] for r in vocabulary.collect()} == counts
    assert told(S.variants(vocabulary, node=64)) == plain(counts)


def test_null_keys_repeated_rows_empty_table_long_words_and_clashing_columns(spark):
    texts = ["x" * 30_000 + " spelling", "x" * 29_999 + "y spelling", None, "", "spelling"] * 2
    rows = list(zip([None, None, 3, 4, 5] * 2, texts))
    got = told(S.variants(S.vocabulary(spark.createDataFrame(rows, "doc_id bigint, text string"))))
    assert got == plain(words_of(rows))
    assert S.variants(S.vocabulary(documents(spark, ["a"]).limit(0))).count() == 0
    assert told(S.variants(spark.createDataFrame([("ab", 1, "?"), ("ab", 2, "?"), (None, 5, "?"), ("a", 30, "?")], "word string, n bigint, root string"))) == [("a", 30, 1, None, None, "a"), ("ab", 3, 1, "a", 30, "a")]
    assert S.vocabulary(clashing(spark, ["spelling spelling"], ["word", "n", "key", "run"])).count() == len(words_of([(0, "spelling spelling")]))
    with pytest.raises(ValueError):
        S.variants(spark.createDataFrame([("a", 1)], "word string, n bigint"), times=1)
