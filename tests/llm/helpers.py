"""Small corpora for the operators' tests, and plain models of what they compute."""

import random

from pyspark.sql import types as T

DOCS = "doc_id bigint, text string"
#: Texts that every operator must take.
ODD = [None, "", " \n\t ", "a", "Ünï ¿cödé 漢字 😀", "x" * 40_000, "word " * 8_000, "same text twice", "same text twice", "1 2 3 4 5", "line\n\nline\n", "\x1c\x0b\x85 odd\u2028spaces"]


def documents(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts)), DOCS)


def clashing(spark, texts, names):
    """documents with further columns that are called like the operators' own."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(n, T.StringType()) for n in names]])
    return spark.createDataFrame([(i, t, *["?"] * len(names)) for i, t in enumerate(texts)], schema)


def corpus(seed=3, n=120, families=6, alphabet="abcdeéß"):
    """Random texts in lines, with exact copies and edited copies of some."""
    rng = random.Random(seed)
    words = ["".join(rng.choices(alphabet, k=rng.randint(2, 7))) for _ in range(400)]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(5, 20))).capitalize() + "."
    texts = ["\n".join(line() for _ in range(rng.randint(1, 6))) for _ in range(n)]
    for f in range(families):
        base = texts[f].split(" ")
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 15))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def components(n, linked):
    """The smallest member that links reach, for each of n vertices."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
