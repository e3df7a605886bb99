"""Hierarchical packing of token sequences into windows of several lengths.

A document that is longer than the longest window gives full windows at once.  What is left of it, and every shorter
document, is routed to the tier of the shortest window that holds it.  Tiers are packed from the longest down: a
window opens with the tier's longest piece, its gap takes the largest pieces of the same or shorter tiers that fit
whole, and only when none fits is one cut to close it.  Windows are powers of two, so a closed window of any tier
needs no padding; the few tokens left at a task's end close windows of smaller powers of two.  The windows of a round
are dealt to step groups of equal token counts so that their attention costs are level.

All of it runs where the rows are: no shuffle, and a worker holds one round of pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark, _tokens

WINDOWS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens of a round, and of a step group.
ROUND_TOKENS = 1 << 20
STEP_TOKENS = 1 << 14

Piece = tuple[int, int, int]  # length, number of the document in the round, start in the document


def fill(pieces: list[Piece], windows: tuple[int, ...]) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows as (size, pieces), and the pieces of the one window that could not be filled."""
    pool = sorted(p for p in pieces if p[0])
    full = []
    for w, shorter in zip(reversed(windows), [*reversed(windows[:-1]), 0]):
        while pool and pool[-1][0] > shorter:
            content, gap = [pool.pop()], 0
            gap = w - content[0][0]
            while gap and pool:
                k = bisect_right(pool, gap, key=lambda p: p[0])
                if k:
                    piece = pool.pop(k - 1)
                else:
                    n, doc, start = pool.pop()
                    piece = (gap, doc, start)
                    insort(pool, (n - gap, doc, start + gap))
                content.append(piece)
                gap -= piece[0]
            if gap:
                return full, content
            full.append((w, content))
    return full, []


def close(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """The pieces in windows of falling powers of two that they fill exactly."""
    left, todo, out = sum(p[0] for p in pieces), list(reversed(pieces)), []
    while left:
        w = 1 << (left.bit_length() - 1)
        content, gap = [], w
        while gap:
            n, doc, start = todo.pop()
            if n > gap:
                todo.append((n - gap, doc, start + gap))
                n = gap
            content.append((n, doc, start))
            gap -= n
        out.append((w, content))
        left -= w
    return out


def steps(windows: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """A step number for each window: windows of one size, step_tokens to a step, dealt in turns by falling cost."""
    number, first = [0] * len(windows), 0
    for size in sorted({w for w, _ in windows}):
        mine = sorted((i for i, (w, _) in enumerate(windows) if w == size), key=lambda i: -sum(p[0] ** 2 for p in windows[i][1]))
        groups = -(-len(mine) * size // step_tokens)
        for turn, i in enumerate(mine):
            lap, k = divmod(turn, groups)
            number[i] = first + (k if lap % 2 == 0 else groups - 1 - k)
        first += groups
    return number


class Packer:
    """Takes documents one by one; gives batches of pieces."""

    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_id")

    def __init__(self, kind: pa.DataType, windows: tuple[int, ...], round_tokens: int, step_tokens: int, part: int) -> None:
        self.kind, self.windows, self.round, self.step_tokens = kind, windows, round_tokens, step_tokens
        self.docs: list[tuple[object, bytes]] = []
        self.pieces: list[Piece] = []
        self.done: list[tuple[int, list[Piece]]] = []
        self.held = 0
        self.sequence = self.step = part << 33

    def add(self, doc_id: object, ids: bytes):
        n, longest, k = len(ids) // 4, self.windows[-1], len(self.docs)
        self.docs.append((doc_id, ids))
        whole = n - n % longest
        self.done += [(longest, [(longest, k, s)]) for s in range(0, whole, longest)]
        if n > whole:
            self.pieces.append((n - whole, k, whole))
        self.held += n
        if self.held >= self.round:
            yield self.flush(False)

    def flush(self, last: bool) -> pa.RecordBatch:
        full, left = fill(self.pieces, self.windows)
        self.done += full
        if last:
            self.done += close(left)
            left = []
        rows: list[tuple] = []
        for step, (w, content) in zip(steps(self.done, self.step_tokens), self.done):
            offset = 0
            for n, k, start in content:
                doc_id, ids = self.docs[k]
                rows.append((doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, self.sequence, offset, w, self.step + step))
                offset += n
            self.sequence += 1
        self.step += len(self.done)
        kept = sorted({k for _, k, _ in left})
        self.pieces = [(n, kept.index(k), start) for n, k, start in left]
        self.docs, self.done, self.held = [self.docs[k] for k in kept], [], 0
        columns = list(zip(*rows)) or [()] * len(self.names)
        return pa.RecordBatch.from_arrays([pa.array(c, self.kind if i == 0 else pa.int64()) for i, c in enumerate(columns)], self.names)


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, windows: tuple[int, ...] = WINDOWS, round_tokens: int = ROUND_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces of all documents of df: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_id.

    path: a vocabulary file for WordEncoder.  A document's ids are its text's, then end_id; a null or empty text has
    only that one.  Each id lies in exactly one piece, each sequence is full: windows are powers of two, as are the
    sequences that end a task.  Rows that repeat a key are documents of their own; null keys are passed on; no rows
    give no rows; other columns are not looked at.  Sequences and steps are numbered by task.
    """
    if any(w & (w - 1) for w in windows) or list(windows) != sorted(set(windows)):
        raise ValueError("windows must be rising powers of two")
    _spark.small_batches(df.sparkSession)
    slim = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encoder, packer = _tokens.WordEncoder.of(path), None
        for batch in batches:
            if packer is None:
                packer = Packer(batch.schema.field(0).type, windows, round_tokens, step_tokens, TaskContext.get().partitionId())
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from packer.add(doc_id, encoder.encode(value or "") + end)
        if packer is not None:
            yield packer.flush(True)

    kind = slim.schema["doc_id"].dataType.simpleString()
    out = _spark.mapped(slim, run, f"doc_id {kind}, " + ", ".join(f"`{n}` bigint" for n in Packer.names[1:]))
    return out.withColumnRenamed("doc_id", key)


def op4_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_spark.table(spark, sf_dir, "documents"), _tokens.vocabulary("word_bpe_49k.json"))
