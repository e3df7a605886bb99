"""Spelling variants: a trie self-join with active-node sets.

Two words at distance one part at some node of the vocabulary's trie: one letter is replaced, or one of the words has a
letter more there, and all behind it is equal.  Down from that node an active pair of nodes allows no further edit, so
it goes on only to children of equal letters, until both ends are words.

The trie is partitioned by prefixes.  A prefix of up to NODE words is a subtree that one task builds and joins with
itself.  A prefix of more words, however many, is joined by Spark at its own depth: the pairs of nodes that part there
meet by what is left when the letter at this depth is taken out, and its words then go down to the longer prefixes.
Each pair parts at one node only, so it is found once.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _links, _spark

#: Words of a subtree that one task joins with itself.
NODE = 8192
#: Letters, A-Z being lowered already.
LETTERS = "[a-zÀ-ÿ]+"
#: One of so many runs, told by a checksum, loses a letter (the contract's rule).
EVERY = 31
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
PAIR = "a string, na bigint, b string, nb bigint"


class Node:
    """A prefix of the words [lo, hi) of a sorted list."""

    __slots__ = ("lo", "hi", "depth", "children")

    def __init__(self, words: list[str], lo: int, hi: int, depth: int) -> None:
        self.lo, self.hi, self.depth = lo, hi, depth
        self.children: dict[str, Node] | None = None

    def grow(self, words: list[str]) -> dict[str, Node]:
        """Children by letter, made when first asked for."""
        if self.children is None:
            self.children, at = {}, self.lo + (len(words[self.lo]) == self.depth)
            while at < self.hi:
                c = words[at][self.depth]
                # the words of a child end where the next letter begins
                end = bisect_left(words, words[at][: self.depth] + chr(ord(c) + 1), at, self.hi)
                self.children[c] = Node(words, at, end, self.depth + 1)
                at = end
        return self.children


def subtree_pairs(words: list[str], depth: int = 0):
    """(i, j), each once: words at distance one of a sorted list of distinct ones that share ``depth`` letters."""

    def equal_tails(u: Node, v: Node, but: str | None = None):
        """Pairs of words of u and v whose rests are equal; v's rest does not begin with ``but``."""
        active = [(u, v, but)]
        while active:
            u, v, but = active.pop()
            one, many = (u, v) if u.hi - u.lo <= v.hi - v.lo else (v, u)
            if one.hi - one.lo == 1:
                rest = words[one.lo][one.depth :]
                if but is None or rest[:1] != but:
                    want = words[many.lo][: many.depth] + rest
                    at = bisect_left(words, want, many.lo, many.hi)
                    if at < many.hi and words[at] == want:
                        yield (one.lo, at) if one is u else (at, one.lo)
                continue
            if len(words[u.lo]) == u.depth and len(words[v.lo]) == v.depth:
                yield u.lo, v.lo
            below = v.grow(words)
            active += [(child, below[c], None) for c, child in u.grow(words).items() if c != but and c in below]

    nodes = [Node(words, 0, len(words), depth)] if words else []
    while nodes:
        node = nodes.pop()
        if node.hi - node.lo == 1:
            continue
        children = node.grow(words)
        for u, v in combinations(children.values(), 2):
            yield from equal_tails(u, v)
        for c, child in children.items():
            # the longer word has a letter more here; where that letter repeats, the words part behind the last one
            yield from equal_tails(child, node, c)
        nodes += children.values()


def _subtrees(key, table):
    rows = sorted(zip(table["word"].to_pylist(), table["n"].to_pylist()))
    words, n = [r[0] for r in rows], [r[1] for r in rows]
    found = [(words[i], n[i], words[j], n[j]) for i, j in subtree_pairs(words, table["depth"][0].as_py())]
    columns = list(zip(*found)) or [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64()) * 2)], ["a", "na", "b", "nb"])


def _parting(large: DataFrame, depth: int) -> DataFrame:
    """Pairs of words of large(word, n) that share ``depth`` letters and part there."""
    word = F.col("word")
    without = F.concat(F.substring(word, 1, depth), F.substring(word, depth + 2, 2**30))
    last = F.substring(word, depth + 1, 1) != F.substring(word, depth + 2, 1)
    longer = large.filter(F.length(word) > depth).select(without.alias("rest"), word.alias("a"), F.col("n").alias("na"), last.alias("last"))
    same = longer.select("rest", F.col("a").alias("b"), F.col("na").alias("nb"), F.lit(True).alias("short"))
    rest = large.select(word.alias("rest"), word.alias("b"), F.col("n").alias("nb"), F.lit(False).alias("short"))
    met = longer.join(same.union(rest), "rest")
    return met.filter("(short and a < b) or (not short and last)").select("a", "na", "b", "nb")


def near_pairs(words: DataFrame, node: int = NODE) -> DataFrame:
    """(a, na, b, nb): the pairs of words(word, n) at distance one, each once; words are distinct and not null."""
    left, depth, small, pairs, scratch = words, 0, [], [], []
    while True:
        prefix = F.substring("word", 1, depth)
        sizes = left.groupBy(prefix.alias("node")).agg(F.count("*").alias("size"))
        large = _spark.written(sizes.filter(F.col("size") > node))
        scratch.append(large)
        n_large = large.count()  # at most one for each ``node`` words
        known = F.broadcast(large) if n_large <= _links.BROADCAST_IDS else large
        told = left.select("word", "n", prefix.alias("node")).join(known, "node", "left")
        small.append(told.filter("size is null").select("node", F.lit(depth).alias("depth"), "word", "n"))
        if not n_large:
            break
        over = _spark.written(told.filter("size is not null").select("word", "n"))
        scratch.append(over)
        pairs.append(_parting(over, depth))
        left, depth = over.filter(F.length("word") > depth), depth + 1
    pairs.append(reduce(DataFrame.union, small).groupBy("node", "depth").applyInArrow(_subtrees, PAIR))
    out = _spark.written(reduce(DataFrame.union, pairs))
    _spark.dropped(*scratch)
    return out


def variants(words: DataFrame, times: int = TIMES, node: int = NODE) -> DataFrame:
    """A row for each of words(word, n): word, n, n_near, form, form_n, root.

    Near words differ by one code point inserted, deleted or replaced.  form is the near word of largest n (ties: the
    smallest in code-point order) if that is ``times`` its own n or more, else null; root follows forms to the last and
    is the word itself without one.  Words that are repeated count together, null ones are left out, the empty word is
    near all words of one letter; no rows give no rows; other columns are not looked at.
    """
    if times < 2:
        raise ValueError("a form must be more frequent than its variants")
    words = _spark.written(words.filter("word is not null").groupBy("word").agg(F.sum("n").cast("bigint").alias("n")))
    pairs = near_pairs(words, node)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("to"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("to"), F.col("na").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("to").alias("to"))).alias("best"), F.first("n").alias("own"))
    fits = -F.col("best.m") >= F.col("own") * times
    near = _spark.written(best.select("word", "n_near", F.when(fits, F.col("best.to")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")))
    hops = _spark.written(near.filter("form is not null").select("word", F.col("form").alias("root")))
    # a form has ``times`` the count, so a chain has few steps; each round doubles what is behind a word
    top = words.agg(F.max("n")).first()[0] or 1
    for _ in range(max(0, math.ceil(math.log2(max(1.0, math.log(max(top, 1), times) + 1))))):
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops, last = _spark.written(hops.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))), hops
        _spark.dropped(last)
    return words.join(near, "word", "left").join(hops, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def shortened(run: Column, key: Column) -> Column:
    """run without one letter where a checksum of key and run says so."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % EVERY == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(df: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of whole texts, A-Z lowered, after shortened(), of ``least_length`` letters and ``least_count``
    occurrences.  A null text has none, a null key counts as the text ''; repeated rows count each; other columns are
    not looked at."""
    run = F.explode(F.filter(F.regexp_extract_all(_spark.ascii_lower(F.col(text)), F.lit(LETTERS), F.lit(0)), lambda w: F.length(w) >= least_length))
    words = df.select(F.col(key).alias("key"), run.alias("run")).select(shortened(F.col("run"), F.col("key")).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def op12_trie_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(_spark.table(spark, sf_dir, "documents").select("doc_id", "text")))


OP12_SQL = r"""
WITH RECURSIVE powers AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS p),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, c, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c // 256, p[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS h
  FROM counted, powers),
told AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM told WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
ranked AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) AS r FROM pairs),
formed AS (
  SELECT w.word, w.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.m >= 10 * w.n THEN k.other END AS form, CASE WHEN k.m >= 10 * w.n THEN k.m END AS form_n
  FROM words w LEFT JOIN ranked k ON k.word = w.word AND k.r = 1),
chain AS (SELECT word, word AS tip, 0 AS steps FROM formed UNION ALL SELECT c.word, f.form, c.steps + 1 FROM chain c JOIN formed f ON f.word = c.tip WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(tip, steps) AS root FROM chain GROUP BY word)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN roots USING (word)
"""
