"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

Each benchmark item has fingerprints of its first and last g words, where g is a grid size just below its length.
Every g-word window of every document is fingerprinted by the same 64-bit SimHash over words: bit counters lie eight
to a 64-bit number (four for long windows), so a window's counters are differences of running sums.  Fingerprints are
cut into four blocks; an item and a window within RADIUS bits agree in some block up to one bit, so an index from
block values to items, with all values one bit away, finds every pair within the radius and compares no others.

The radius alone promises nothing for a copy that is edited or trimmed at both ends.  So each item also has the
fingerprints of some of its 5-word windows, its anchors: more of them than shingles can be missing at the similarity
asked for, so that every such copy has one of them whole, with an equal fingerprint.  Candidates are verified by the
similarity of 5-word shingles, weighted by their occurrences, between the item and every item-sized window of the text.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark, _text

SHINGLE = 5
SIMILARITY = 0.8
#: Four blocks, each searched up to one bit: all fingerprints within 4 * 2 - 1 bits.
RADIUS = 7
#: Ratio of the grid of window sizes, the longest window whose bit counters fit a byte, and the longest of all.
RATIO, BYTE, LONGEST = 1.22, 120, 32_000
#: Items that one pass over the documents looks for; more are taken in further passes.
BLOCK_ITEMS, BLOCK_BYTES = 1 << 15, 16 << 20

def grid() -> list[int]:
    sizes, x = [SHINGLE], float(SHINGLE)
    while sizes[-1] < LONGEST:
        x *= RATIO
        if int(x) > sizes[-1]:
            sizes.append(min(int(x), LONGEST))
    return sizes


def _repeated(value: int, lane: int) -> np.uint64:
    return np.uint64(sum(value << at for at in range(0, 64, lane)))


class Sums:
    """Running sums of the bits of word hashes, in lanes of 8 bits, or of 16 for windows of more than BYTE words."""

    def __init__(self, h: np.ndarray) -> None:
        self.h, self.made = h, {}

    def lanes(self, lane: int) -> list[np.ndarray]:
        """For each 64 // lane bits of the hashes, running sums of them: bit k in lane k."""
        if lane not in self.made:
            n = 64 // lane
            spread = np.zeros(1 << n, np.uint64)
            for k in range(n):
                spread |= ((np.arange(1 << n, dtype=np.uint64) >> np.uint64(k)) & np.uint64(1)) << np.uint64(lane * k)
            self.made[lane] = []
            for k in range(lane):
                s = np.zeros(len(self.h) + 1, np.uint64)
                np.cumsum(spread[((self.h >> np.uint64(n * k)) & np.uint64((1 << n) - 1)).astype(np.uint8)], out=s[1:])
                self.made[lane].append(s)
        return self.made[lane]

    def prints(self, start: np.ndarray | slice, stop: np.ndarray | slice, size: int) -> np.ndarray:
        """SimHash of the windows [start, stop), of size words each: a bit is set where most words have it."""
        lane = 8 if size <= BYTE else 16
        n, half = 64 // lane, 1 << (lane - 1)
        bias, high = _repeated(half - 1 - size // 2, lane), _repeated(half, lane)
        # moves lane k's lowest bit to bit k of the upper n bits
        gather = np.uint64(sum(1 << (64 - n + k - lane * k) for k in range(n)))
        out = None
        for k, s in enumerate(self.lanes(lane)):
            x = s[stop] - s[start]
            x += bias
            x &= high
            x >>= np.uint64(lane - 1)
            x *= gather
            x >>= np.uint64(64 - n)
            if k:
                x <<= np.uint64(n * k)
                out |= x
            else:
                out = x
        return out


class Prints:
    """A multi-index of fingerprints: from the values of each block, up to one bit, to the fingerprints that have them."""

    near = np.array([0, *(1 << k for k in range(16))], np.int64)

    def __init__(self, prints: np.ndarray) -> None:
        self.prints, self.any, self.first, self.owners = prints, [], [], []
        for b in range(4):
            value = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            value = (value[:, None] ^ self.near).ravel()
            order = np.argsort(value, kind="stable")
            count = np.bincount(value, minlength=1 << 16)
            self.any.append(count > 0)
            self.first.append(np.concatenate([[0], np.cumsum(count)]))
            self.owners.append(order // len(self.near))

    def search(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among marks, place among the fingerprints) of pairs within the radius, some more than once."""
        found = [np.zeros((2, 0), np.int64)]
        for b in range(4):
            value = ((marks >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            at = np.flatnonzero(self.any[b][value])
            first = self.first[b][value[at]]
            n = self.first[b][value[at] + 1] - first
            mark = np.repeat(at, n)
            own = self.owners[b][np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(mark))]
            good = np.bitwise_count(marks[mark] ^ self.prints[own]) <= RADIUS
            found.append(np.stack([mark[good], own[good]]))
        return tuple(np.concatenate(found, axis=1))


def n_anchors(total: int) -> int:
    """Shingles of an item of so many, one of which is in every window that is similar enough: at least the share
    SIMILARITY of them is common to both."""
    least = next(k for k in range(total + 1) if k / total >= SIMILARITY)
    return total - least + 1


def best_window(runs: np.ndarray, n_words: int, kinds: np.ndarray, most: np.ndarray, m_words: int) -> tuple[float, int, int]:
    """(similarity, first word, words) of the first best item-sized window of a text.

    runs: the text's shingles; kinds and most: the item's distinct shingles, sorted, and their occurrences.
    """
    size = min(n_words, m_words)
    total, own = int(most.sum()), size - SHINGLE + 1
    at = np.searchsorted(kinds, runs)
    at[at == len(kinds)] = 0
    place = np.flatnonzero(kinds[at] == runs)
    kind = at[place]
    # an occurrence counts in windows that reach it and hold fewer than most earlier ones of its kind
    order = np.lexsort((place, kind))
    place, kind = place[order], kind[order]
    since = np.full(len(place), -1)
    for c in np.unique(most[kind]).tolist():
        mine = np.flatnonzero(most[kind] == c)
        mine = mine[mine >= c]
        mine = mine[kind[mine - c] == kind[mine]]
        since[mine] = place[mine - c]
    steps = np.zeros(len(runs) + 1, np.int64)
    np.add.at(steps, np.maximum(since, np.maximum(place - own, -1)) + 1, 1)
    np.add.at(steps, place + 1, -1)
    common = np.cumsum(steps)[: n_words - size + 1]
    s = int(common.argmax())
    both = int(common[s])
    return both / (total + own - both), s, size


class Items:
    """An index of items by window size, and of their anchors."""

    @classmethod
    def of(cls, name: str, items: list[tuple[object, bytes]]) -> Items:
        """The index of a block that was sent, made once for a worker."""
        cache = _spark.worker_cache()
        if cache.get("items", (None,))[0] != name:
            cache["items"] = (name, cls([(k, np.frombuffer(h, np.uint64)) for k, h in items]))
        return cache["items"][1]

    def __init__(self, items: list[tuple[object, np.ndarray]]) -> None:
        self.items = []
        for i, h in items:
            runs = _text.shingle_runs(h, np.array([0, len(h)]), SHINGLE)[0]
            self.items.append((i, h, *np.unique(runs, return_counts=True)))
        sizes = np.array(grid())
        by: dict[int, list[tuple[int, int]]] = {}
        for n, (_, h, *_) in enumerate(self.items):
            g = int(sizes[np.searchsorted(sizes, len(h), side="right") - 1])
            sums = Sums(h)
            for at in sorted({0, len(h) - g}):
                by.setdefault(g, []).append((int(sums.prints(np.array([at]), np.array([at + g]), g)[0]), n))
        self.sizes = {g: (Prints(np.array([f for f, _ in found], np.uint64)), np.array([n for _, n in found])) for g, found in by.items()}
        self._anchor()

    def _anchor(self) -> None:
        """Of each item, anchors that few other items have; anchors are sorted, and a table tells their upper bits."""
        own = [Sums(h).prints(slice(None, len(h) - SHINGLE + 1), slice(SHINGLE, None), SHINGLE) for _, h, *_ in self.items]
        shared = Counter(f for marks in own for f in set(marks.tolist()))
        pairs = sorted({(f, n) for n, marks in enumerate(own) for f in sorted(marks.tolist(), key=shared.__getitem__)[: n_anchors(len(marks))]})
        self.anchors, self.anchored = np.array([f for f, _ in pairs], np.uint64), np.array([n for _, n in pairs], np.int64)
        bits = min(24, max(16, len(pairs).bit_length() + 5))
        self.shift, self.upper = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.upper[(self.anchors >> self.shift).astype(np.int64)] = True

    def candidates(self, h: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(text, item): pairs that share an anchor, or have fingerprints that lie within the radius."""
        sums, out = Sums(h), set()
        counts = np.diff(first)
        text_of = np.repeat(np.arange(len(counts)), counts)
        if len(h) >= SHINGLE:
            marks = sums.prints(slice(None, len(h) - SHINGLE + 1), slice(SHINGLE, None), SHINGLE)
            at = np.flatnonzero(self.upper[(marks >> self.shift).astype(np.int64)])
            at = at[text_of[at] == text_of[at + SHINGLE - 1]]
            low, high = (np.searchsorted(self.anchors, marks[at], side=side) for side in ("left", "right"))
            for i in np.flatnonzero(high > low).tolist():
                t = int(text_of[at[i]])
                out |= {(t, n) for n in self.anchored[low[i] : high[i]].tolist()}
        for g, (prints, owners) in self.sizes.items():
            if len(h) >= g:
                inside = np.flatnonzero(text_of[: len(h) - g + 1] == text_of[g - 1 :])
                mark, own = prints.search(sums.prints(slice(None, len(h) - g + 1), slice(g, None), g)[inside])
                out |= set(zip(text_of[inside[mark]].tolist(), owners[own].tolist()))
            # texts a little shorter than the window are windows of their own
            short = np.flatnonzero((counts < g) & (counts >= g * SIMILARITY))
            for n in np.unique(counts[short]).tolist():
                start = first[short[counts[short] == n]]
                mark, own = prints.search(sums.prints(start, start + n, n))
                out |= set(zip(text_of[start[mark]].tolist(), owners[own].tolist()))
        return out

    def hits(self, h: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[object, int, int, float]]]:
        """For each text with any: (item id, first word, words, similarity) of the best window of each item in it."""
        out: dict[int, list] = {}
        runs = None
        for t, n in sorted(self.candidates(h, first)):
            if runs is None:
                runs, at = _text.shingle_runs(h, first, SHINGLE)
            item_id, own, kinds, most = self.items[n]
            words = int(first[t + 1] - first[t])
            if words >= SHINGLE:
                alike, s, size = best_window(runs[at[t] : at[t + 1]], words, kinds, most, len(own))
                if alike >= SIMILARITY:
                    out.setdefault(t, []).append((item_id, s, size, alike))
        return out


def _item_blocks(items: DataFrame, key: str, text: str):
    """Lists of (id, word hashes) of the items, bounded in number and bytes."""
    block, held = [], 0
    for row in items.select(F.col(key).alias("k"), F.col(text).alias("t")).toLocalIterator():
        buf = np.frombuffer((row["t"] or "").encode("utf-8", "surrogatepass"), np.uint8)
        h, _ = _text.word_hashes(_text.lower(buf), np.array([0, len(buf)]))
        if len(h) >= SHINGLE:
            block.append((row["k"], h))
            held += len(buf)
        if len(block) >= BLOCK_ITEMS or held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    yield block


def flagged(df: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", keep_text: bool = True, name: str = "_hits") -> DataFrame:
    """df with a column ``name``: array of (item_id, first_word, n_words, similarity) of the items that its text holds.

    Words are what white space (space, codes 9 to 13) divides, A-Z lowered.  Items of fewer than 5 words, and texts
    without words, match nothing.  A null text has no words.  Items that repeat are each reported, rows of df that
    repeat each have their hits, and keys are not looked at, so null ones do no harm; of equally similar windows the
    first is told.  A column of df that is called ``name`` is an error; others pass through.  The items are taken in
    blocks of bounded size, each looked for by a pass over all documents.
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    spark = df.sparkSession
    _spark.small_batches(spark)
    item_kind = items.schema[item_key].dataType.simpleString()
    kind = f"array<struct<item_id:{item_kind},first_word:int,n_words:int,similarity:double>>"
    out = df.select(text, *[c for c in df.columns if c != text]).withColumn(name, F.array().cast(kind))
    for block in _item_blocks(items, item_key, item_text):
        if not block:
            continue
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, [(k, h.tobytes()) for k, h in block]))

        def run(batches, sent=sent):
            index = Items.of(*sent.value)
            for batch in batches:
                buf, off = _text.strings(batch.column(0))
                found: dict[int, list] = {}
                for a, b in _text.slices(off, 1 << 19):
                    h, first = _text.word_hashes(_text.lower(buf[off[a] : off[b]]), off[a : b + 1] - off[a])
                    found |= {a + t: v for t, v in index.hits(h, first).items()}
                field = batch.schema.field(batch.num_columns - 1)
                if found:
                    old = batch.column(batch.num_columns - 1).to_pylist()
                    names = [f.name for f in field.type.value_type]
                    new = pa.array([[*(old[i] or []), *(dict(zip(names, v)) for v in found.get(i, []))] for i in range(batch.num_rows)], field.type)
                    batch = batch.set_column(batch.num_columns - 1, field, new)
                yield batch

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
        out = _spark.mapped(out, run, fields)
    return out if keep_text else out.drop(text)


def contaminated(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that it holds: key, item_id, first_word, n_words, similarity.  See flagged()."""
    slim = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = flagged(slim, items, "_text", item_key, item_text, keep_text=False)
    return rows.select(F.col("_key").alias(key), F.explode("_hits").alias("h")).select(key, "h.*")


def op1_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_spark.table(spark, sf_dir, "documents"), _spark.table(spark, sf_dir, "benchmark"))


_LOW = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+')"
_RUNS = "unnest(list_transform(range(1, len(w) - 3), lambda i: {'p': i - 1, 'x': array_to_string(w[i:i + 4], ' ')}))"
#: Every item-sized window of every document that shares a shingle with an item.
OP1_SQL = f"""
WITH items AS (SELECT item_id, {_LOW} AS w FROM benchmark),
docs AS (SELECT doc_id, {_LOW} AS w FROM documents),
item_runs AS (SELECT item_id, len(w) AS m, {_RUNS} AS r FROM items WHERE len(w) >= 5),
bags AS (SELECT item_id, m, r.x AS x, count(*) AS c FROM item_runs GROUP BY ALL),
doc_runs AS (SELECT doc_id, len(w) AS n, {_RUNS} AS r FROM docs WHERE len(w) >= 5),
met AS (SELECT doc_id, item_id, n, m, c, r.p AS p, x FROM doc_runs JOIN bags ON r.x = x),
pairs AS (SELECT doc_id, item_id, n, m FROM met GROUP BY ALL HAVING count(*) >= 0.8 * (least(n, m) - 4) - 1),
windows AS (SELECT *, unnest(range(greatest(n - m, 0) + 1)) AS s FROM pairs),
shared AS (SELECT v.doc_id, v.item_id, v.n, v.m, v.s, x, least(count(*), c) AS k FROM windows v JOIN met t ON t.doc_id = v.doc_id AND t.item_id = v.item_id AND p >= s AND p <= s + least(v.n, v.m) - 5 GROUP BY v.doc_id, v.item_id, v.n, v.m, v.s, x, c),
scored AS (SELECT doc_id, item_id, s, least(n, m) AS n_words, sum(k)::DOUBLE / ((m - 4) + (least(n, m) - 4) - sum(k)) AS similarity FROM shared GROUP BY doc_id, item_id, s, n, m)
SELECT doc_id, item_id, s AS first_word, n_words, similarity FROM scored WHERE similarity >= 0.8::DOUBLE
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) = 1
"""
