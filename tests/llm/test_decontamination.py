from collections import Counter

import pytest

from budgetlens.llm import decontamination as D
from tests.llm.helpers import ODD, clashing, corpus, documents


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def brute(texts, items):
    out = set()
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "").split()
    for d, text in enumerate(texts):
        words = low(text)
        for i, item in enumerate(items):
            own = low(item)
            if len(own) < 5:
                continue
            a, best = shingles(own), 0.0
            for s in range(max(1, len(words) - len(own) + 1)):
                b = shingles(words[s : s + len(own)])
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= 0.8:
                out.add((d, i))
    return out


def case(seed=5):
    texts = corpus(seed, 60, 2, "abcdefgh")
    items = [" ".join(texts[k].split()[:n]) for k, n in ((3, 12), (8, 25), (11, 60))] + ["no such passage in any of the texts here", "too short", "", None]
    for k, item in enumerate(items[:3]):
        words = item.split()
        texts.append("Before it " + item.upper() + " and after it.")
        texts.append("Cut " + " ".join(words[1:]) + " off")
        texts.append(" ".join(words[: len(words) // 2]) + " only half " * k)
        texts.append(item)
    return texts, items


def test_hits_equal_brute_force(spark):
    texts, items = case()
    texts = texts + ODD[:8]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = D.contaminated(documents(spark, texts).repartition(3), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(texts, items)
    assert all(0.8 <= r["similarity"] <= 1 for r in got) and len(got) == len({(r["doc_id"], r["item_id"]) for r in got})


def test_edited_and_trimmed_passages_are_all_found(spark):
    """Copies of similarity 0.8 or more with words replaced, put in, left out, or cut off at both ends, by brute force."""
    import random

    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    some = lambda n: rng.choices(words, k=n)
    items = [some(n) for n in (5, 6, 13, 20, 24, 29, 29, 36, 50, 59, 120, 150)]
    items.append(items[3][:10] * 4)
    texts = []
    for own in items:
        for _ in range(25):
            copy, edit = list(own), rng.randrange(4)
            if edit == 0:
                for _ in range(rng.randint(1, max(1, len(own) // 40))):
                    copy[rng.randrange(len(copy))] = "replaced"
            elif edit == 1:
                cut = rng.randint(0, len(own) // 9)
                front = rng.randint(0, cut)
                copy = copy[front : len(copy) - (cut - front)]
            elif edit == 2:
                copy.insert(rng.randrange(len(copy) + 1), "added")
            else:
                del copy[rng.randrange(len(copy))]
            texts.append(" ".join(some(rng.choice((0, 40))) + copy + some(rng.choice((0, 40)))))
    texts.append(" ".join(items[5] + items[5][:20]))
    bench = [" ".join(i) for i in items]
    want = brute(texts, bench)
    got = D.contaminated(documents(spark, texts), spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string")).collect()
    assert len(want) > 150 and {(r["doc_id"], r["item_id"]) for r in got} == want
    for r in got:
        own, text = bench[r["item_id"]].split(), texts[r["doc_id"]].split()
        a, scores = shingles(own), []
        for s in range(max(1, len(text) - len(own) + 1)):
            b = shingles(text[s : s + len(own)])
            both = sum((a & b).values())
            scores.append(both / (sum(a.values()) + sum(b.values()) - both))
        assert r["similarity"] == max(scores) and r["first_word"] == scores.index(max(scores)) and r["n_words"] == min(len(own), len(text))


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    texts, items = case()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    whole = {tuple(r) for r in D.contaminated(documents(spark, texts), bench).collect()}
    monkeypatch.setattr(D, "BLOCK_ITEMS", 1)
    assert {tuple(r) for r in D.contaminated(documents(spark, texts), bench).collect()} == whole


def test_fingerprints_equal_a_plain_simhash():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 1 << 63, 400, dtype=np.uint64)
    sums = D.Sums(h)
    for size in (5, 8, 31, 120, 121, 255, 256, 399):
        got = sums.prints(np.arange(400 - size + 1), np.arange(size, 401), size)
        for s, f in list(enumerate(got.tolist()))[::37]:
            ones = [sum(int(x) >> b & 1 for x in h[s : s + size]) for b in range(64)]
            assert f == sum(1 << b for b, n in enumerate(ones) if n > size // 2)


def test_every_fingerprint_within_the_radius_is_found_and_no_other():
    import random

    import numpy as np

    rng, own = random.Random(2), np.random.default_rng(3).integers(0, 1 << 63, 300, dtype=np.uint64)
    marks = []
    for _ in range(600):
        x = int(rng.choice(own.tolist()))
        for b in rng.sample(range(64), rng.randint(0, 12)):
            x ^= 1 << b
        marks.append(x)
    marks = np.array(marks, np.uint64)
    near = np.bitwise_count(marks[:, None] ^ own[None, :]) <= D.RADIUS
    assert set(zip(*(x.tolist() for x in D.Prints(own).search(marks)))) == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_copies_whose_ends_differ_are_found_at_every_length(spark):
    """Recall against brute force: the first and last words replaced, as many as similarity 0.8 allows."""
    import random

    rng = random.Random(4)
    items, texts = [], []
    for n in (20, 60, 100, 120, 300, 600):
        for _ in range(6):
            own = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            cut = next(k for k in range(n, -1, -1) if n - 4 - k > 0 and (n - 4 - k) / (n - 4 + k) >= 0.8)
            front = rng.randint(0, cut)
            copy = [*["other"] * front, *own[front : n - (cut - front)], *["else"] * (cut - front)]
            items.append(" ".join(own))
            texts.append(" ".join([*["before"] * rng.choice((0, 30)), *copy, *["behind"] * rng.choice((0, 30))]))
    want = brute(texts, items)
    assert len(want) == len(items)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(documents(spark, texts), bench).collect()} == want


def test_empty_tables_and_clashing_columns(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    assert D.contaminated(documents(spark, ["x"]).limit(0), bench).count() == 0
    assert D.contaminated(documents(spark, ["x", None]), bench.limit(0)).count() == 0
    docs = clashing(spark, ["One two three four five six", None], ["item_id", "similarity", "h"])
    assert [tuple(r)[:2] for r in D.contaminated(docs, bench).collect()] == [(0, 1)]
    assert D.flagged(docs, bench).count() == 2
    docs = clashing(spark, ["One two three four five six"], ["_hits", "_key", "_text"])
    assert [tuple(r)[:2] for r in D.contaminated(docs, bench).collect()] == [(0, 1)]
    assert D.flagged(docs, bench, name="found").select("_hits").collect()[0][0] == "?"
    with pytest.raises(ValueError):
        D.flagged(docs, bench)


def test_null_keys_repeated_rows_and_ties(spark):
    bench = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six")], "item_id bigint, text string")
    text = "x one two three four five six y one two three four five six"
    docs = spark.createDataFrame([(None, text), (7, text), (7, text)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0, r["first_word"]) for r in D.contaminated(docs, bench).collect())
    assert got == sorted([(d, i, 1) for d in (0, 7, 7) for i in (1, 1, 0)])
