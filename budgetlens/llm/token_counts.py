"""Edit-aware token counts.

Each document keeps a segment tree over its pre-tokens: a leaf stands for a run of LEAF pre-tokens and holds its
characters and tokens, an inner node the sums of FAN children.  An edit finds its leaf by walking down the sums,
re-encodes from a leaf boundary a few characters before it until a pre-token boundary meets an old leaf boundary
behind it, replaces these leaves and renews the sums above them.  Pre-tokenization looks only forward, so the leaves
before and behind keep their counts.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark, _tokens

LEAF = 32
FAN = 8
#: A pre-token's end depends on at most so many characters behind it.
CONTEXT = 3
STATE = "leaf_chars array<int>, leaf_tokens array<int>"
EDITS = "array<struct<start:bigint,stop:bigint,text:string>>"


class Tree:
    """Sums of characters and tokens over leaves, in levels from the leaves up."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.levels = [(chars, tokens)]
        self._renew(0)

    def _renew(self, leaf: int) -> None:
        """Sums above the leaves from ``leaf`` on."""
        level = 0
        while len(self.levels[level][0]) > 1:
            if len(self.levels) == level + 1:
                self.levels.append(([], []))
            leaf //= FAN
            for below, above in zip(self.levels[level], self.levels[level + 1]):
                del above[leaf:]
                above.extend(sum(below[i : i + FAN]) for i in range(leaf * FAN, len(below), FAN))
            level += 1
        del self.levels[level + 1 :]

    def totals(self) -> tuple[int, int]:
        return sum(self.levels[-1][0]), sum(self.levels[-1][1])

    def locate(self, char: int) -> tuple[int, int]:
        """The last leaf that begins at or before char, and where it begins."""
        node, begin = 0, 0
        for level in range(len(self.levels) - 1, -1, -1):
            sums = self.levels[level][0]
            if level < len(self.levels) - 1:
                node *= FAN
            stop = min(len(sums), node + FAN) if level < len(self.levels) - 1 else len(sums)
            while node + 1 < stop and begin + sums[node] <= char:
                begin += sums[node]
                node += 1
        return node, begin

    def splice(self, first: int, stop: int, chars: list[int], tokens: list[int]) -> None:
        same = len(chars) == stop - first
        self.levels[0][0][first:stop], self.levels[0][1][first:stop] = chars, tokens
        if same:
            for leaf in range(first, stop):
                self._path(leaf)
        else:
            self._renew(first)

    def _path(self, leaf: int) -> None:
        for level in range(len(self.levels) - 1):
            leaf //= FAN
            for below, above in zip(self.levels[level], self.levels[level + 1]):
                above[leaf] = sum(below[leaf * FAN : (leaf + 1) * FAN])


def leaves(counter: _tokens.PieceCounter, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each leaf of a text."""
    pieces = counter.pattern.findall(text)
    if not pieces:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    at = np.arange(0, len(pieces), LEAF)
    chars = np.add.reduceat(np.fromiter(map(len, pieces), np.int32, len(pieces)), at, dtype=np.int32)
    return chars, np.add.reduceat(np.fromiter(map(counter.memo.__getitem__, pieces), np.int32, len(pieces)), at, dtype=np.int32)


def edited(counter: _tokens.PieceCounter, text: str, tree: Tree, start: int, stop: int, new: str) -> tuple[str, int]:
    """The text with [start, stop) replaced by new, and how many characters were encoded for it.  tree is changed."""
    start = max(0, min(start, len(text)))
    stop = max(start, min(stop, len(text)))
    after = text[:start] + new + text[stop:]
    shift, fresh = len(after) - len(text), start + len(new)
    first, begin = tree.locate(max(0, start - CONTEXT))
    if begin > max(0, start - CONTEXT):
        first, begin = 0, 0
    chars, tokens, at = [], [], begin
    old, old_at = tree.levels[0][0], begin
    last = first
    pieces = counter.pattern.finditer(after, begin)
    while True:
        run_chars = run_tokens = 0
        met = False
        for piece in islice(pieces, LEAF):
            run_chars += piece.end() - piece.start()
            run_tokens += counter.memo[piece.group()]
            here = at + run_chars
            if here >= fresh:
                while last < len(old) and old_at + shift < here:
                    old_at += old[last]
                    last += 1
                if old_at >= stop and old_at + shift == here:
                    met = True
                    break
        if run_chars:
            chars.append(run_chars)
            tokens.append(run_tokens)
            at += run_chars
        if met or not run_chars:
            break
    if at >= len(after):
        last = len(old)
    tree.splice(first, last, chars, tokens)
    return after, at - begin


def build(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with n_tokens, leaf_chars and leaf_tokens: the count of each whole text and its tree's leaves.

    path: a vocabulary in rank form.  A null or empty text has 0 tokens and no leaves.  Each row stands for itself, so
    repeated rows and null keys are counted like others.  Columns of these names are replaced.
    """
    _spark.small_batches(df.sparkSession)
    others = [c for c in df.columns if c not in (text, "n_tokens", "leaf_chars", "leaf_tokens")]
    slim = df.select(text, *others)

    def run(batches):
        counter = _tokens.PieceCounter.of(path)
        for batch in batches:
            both = [leaves(counter, t or "") for t in batch.column(0).to_pylist()]
            off = np.cumsum([0, *(len(c) for c, _ in both)], dtype=np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, np.int32), *(b[k] for b in both)]))) for k in (0, 1)]
            totals = pa.array([int(t.sum()) for _, t in both], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, totals, *lists], [*batch.schema.names, "n_tokens", "leaf_chars", "leaf_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    return _spark.mapped(slim, run, f"{fields}, n_tokens bigint, {STATE}")


def apply_edits(state: DataFrame, path: str, edits: str = "edits", text: str = "text") -> DataFrame:
    """state (see build()) after its column of edits, without that column, and with reencoded_chars.

    edits: array of (start, stop, text), code points of the text as it is when the edit's turn comes; they are cut to
    its bounds, and a null start, stop or text counts as 0, start or ''.  No edits leave a row as it is.
    """
    _spark.small_batches(state.sparkSession)
    own = (text, "n_tokens", "leaf_chars", "leaf_tokens", edits)
    others = [c for c in state.columns if c not in (*own, "reencoded_chars")]
    slim = state.select(*own, *others)

    def run(batches):
        counter = _tokens.PieceCounter.of(path)
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)))
            out = []
            for value, chars, tokens, changes in rows:
                tree, total = Tree(chars or [], tokens or []), 0
                for e in changes or []:
                    start = e["start"] or 0
                    value, n = edited(counter, value or "", tree, start, start if e["stop"] is None else e["stop"], e["text"] or "")
                    total += n
                out.append((value, tree.totals()[1], *tree.levels[0], total))
            new = [pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()))]
            if out:
                yield pa.RecordBatch.from_arrays([*new[:4], *batch.columns[5:], new[4]], [text, "n_tokens", "leaf_chars", "leaf_tokens", *others, "reencoded_chars"])

    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[5:])
    return _spark.mapped(slim, run, f"`{text}` string, n_tokens bigint, {STATE}{fields}, reencoded_chars bigint")


def with_edits(state: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """state with a column ``edits`` from changes(key, turn, start, stop, text); keys that state lacks are dropped."""
    grouped = changes.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("turn", "start", "stop", "text"))).alias("_all"))
    edits = F.transform("_all", lambda e: F.struct(e["start"].cast("bigint").alias("start"), e["stop"].cast("bigint").alias("stop"), e["text"].alias("text")))
    return state.join(grouped, F.col(key) == F.col("_key"), "left").withColumn("edits", edits).drop("_key", "_all")


def op10_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, before and after three edits of each: a replacement, an insertion, a deletion."""
    path = _tokens.vocabulary("byte_bpe_50k.tiktoken")
    docs = _spark.table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    edit = lambda start, stop, new: F.struct(start.alias("start"), stop.alias("stop"), F.lit(new).alias("text"))
    third = F.floor(n / 3)
    changes = F.array(edit(third, third + 5, "Δ it's"), edit(2 * third, 2 * third, " inserted words, 42 "), edit(F.greatest(n - 7, F.lit(0)), n, ""))
    state = build(docs, path).withColumn("edits", changes).withColumn("tokens_before", F.col("n_tokens"))
    return apply_edits(state, path).select("doc_id", "tokens_before", F.col("n_tokens").alias("tokens_after"), "reencoded_chars", F.length("text").cast("bigint").alias("n_chars"))
