"""SentencePiece BPE: texts to ids and back, by vectorised merge rounds.

A text is cut where no piece of the vocabulary can reach across: before a space mark behind another character, and
around characters that are in no longer piece.  Each distinct word of a worker is encoded once.  All new words of a
batch lie in one flat numpy array of symbols.  In each round the rank of every pair of neighbours is known, a segmented
minimum finds the best pair of each word, its leftmost place merges in all words at once, and the array is compacted;
words without a pair that a piece joins leave the array, and the rounds end when no word is left.  The order of merges
is that of the library: by score, ties by place.  Words of more than LONG symbols, which would take as many rounds, are
merged by a heap of the same keys.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark, _text, _tokens

SPACE = "▁"
#: Symbols beyond which a word takes the heap.
LONG = 512
#: Characters of new words that are encoded together.
ROUND_CHARS = 1 << 18
#: Entries after which a worker's memo begins a new generation, and their longest length.  It changes speed only.
MEMO, MEMO_CHARS = 250_000, 64
NONE = np.int64(1) << np.int64(40)
#: Kinds of pieces in the model file's format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5

codecs.register_error("budgetlens_each_byte", lambda e: ("�", e.start + 1))


class Memo:
    """Keys that a worker has encoded: those of the last generation are moved on as they are met again."""

    def __init__(self, make: Callable[[list[str]], list[bytes]]) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.make = make

    def joined(self, lists: list[list[str]]) -> list[bytes]:
        """What make() gives for each list's keys, joined."""
        if len(self.new) > MEMO:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = [k for k in set().union(*lists) if k not in new]
        fresh = [k for k in missing if k not in old]
        new.update((k, old[k]) for k in missing if k in old)
        new.update(zip(fresh, self.make(fresh)))
        out = [b"".join(map(new.__getitem__, keys)) for keys in lists]
        for k in fresh:
            if len(k) > MEMO_CHARS:
                del new[k]
        return out


class Pieces:
    """Tables of a BPE model with byte fallback: ids, merge ranks, surfaces."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = [p.type for p in model.pieces]
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        if train.model_type != 2 or not train.byte_fallback or not plain or USER in kinds or UNUSED in kinds or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, identity normalisation and a leading space mark are read")
        self.pieces, self.kinds = [p.piece for p in model.pieces], np.array(kinds)
        self.unknown_surface = train.unk_surface
        self.end_id = self.pieces.index(train.eos_piece)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == BYTE}
        # symbols: the pieces that take part in merges under their ids, then characters that are pieces' parts only
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        self.symbol = dict(self.ids)
        for p in self.ids:
            for c in p:
                self.symbol.setdefault(c, len(self.pieces) + len(self.symbol))
        self.names = {s: p for p, s in self.symbol.items()}
        scores = sorted({-model.pieces[i].score for p, i in self.ids.items() if len(p) > 1})
        rank = {s: r for r, s in enumerate(scores)}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = (rank[-model.pieces[i].score], i)
        keys = sorted(self.pairs)
        self.base = np.int64(max(self.symbol.values(), default=0) + 2)
        self.keys = np.array([a for a, _ in keys], np.int64) * self.base + np.array([b for _, b in keys], np.int64)
        self.ranks, self.merged = (np.array([self.pairs[k][j] for k in keys], np.int64) for j in (0, 1))
        # characters that no longer piece has stand alone; a space mark inside a piece would keep words together
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined and chr(c) != " ")
        word = f"[^{alone}]+" if inner else f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+"
        self.words = re.compile(f"[{alone}]|{word}" if alone else word)
        self.surfaces = [self._surface(i) for i in range(len(self.pieces))]
        self.lengths = np.array([len(s) for s in self.surfaces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.surfaces), np.uint8)
        self.led = np.array([p.startswith(SPACE) and k == NORMAL for p, k in zip(self.pieces, kinds)])
        self.of_code = np.full(0x110000, -1, np.int32)
        for p, i in self.symbol.items():
            if len(p) == 1:
                self.of_code[ord(p)] = i
        self.parts, self.marked = Memo(self._encode_parts), Memo(self.encode_words)

    @classmethod
    def of(cls, path: str) -> Pieces:
        cache = _spark.worker_cache()
        if ("sentencepiece", path) not in cache:
            cache["sentencepiece", path] = cls(path)
        return cache["sentencepiece", path]

    def _surface(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return self.unknown_surface.encode()
        return bytes([int(self.pieces[i][3:5], 16)]) if kind == BYTE else self.pieces[i].replace(SPACE, " ").encode()

    # encoding

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs (NONE where no piece joins them) and what they merge to."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.merged[at]

    def _rounds(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of words sym[first[i]:first[i + 1]], in the same layout.  No word is empty."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        word = np.arange(len(first) - 1)
        size = np.diff(first)
        sym, first = sym.copy(), first[:-1].copy()
        rank, into = self._pair_ranks(sym, first)
        while len(word):
            best = np.minimum.reduceat(rank, first)
            over = best == NONE
            if over.any():
                live = np.repeat(~over, size)
                done.append((word[over], size[over], sym[~live]))
                sym, rank, into = sym[live], rank[live], into[live]
                word, size, best = word[~over], size[~over], best[~over]
                if not len(word):
                    break
                first = np.cumsum(size) - size
            # the leftmost best place of each word
            hit = np.flatnonzero(rank == np.repeat(best, size))
            owner = np.searchsorted(first, hit, side="right") - 1
            at = hit[np.append(True, owner[1:] != owner[:-1])]
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            sym, rank, into = sym[keep], rank[keep], into[keep]
            size = size - 1
            first = np.cumsum(size) - size
            # only the pairs that touch a merged symbol are new
            touched = np.concatenate([at, at[at > first] - 1])
            inside = touched + 1 < (first + size)[np.searchsorted(first, touched, side="right") - 1]
            rank[touched[~inside]] = NONE
            touched = touched[inside]
            rank[touched], into[touched] = self._rank(sym[touched], sym[touched + 1])
        order = np.concatenate([d[0] for d in done] or [np.zeros(0, np.int64)])
        sizes = np.concatenate([d[1] for d in done] or [np.zeros(0, np.int64)])
        flat = np.concatenate([d[2] for d in done] or [np.zeros(0, np.int64)])
        begin = np.cumsum(sizes) - sizes
        by = np.argsort(order, kind="stable")
        out = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes[by], out=out[1:])
        return flat[np.repeat(begin[by] - out[:-1], sizes[by]) + np.arange(out[-1])], out

    def _pair_ranks(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each symbol's pair with the next; NONE for the last of a word."""
        rank, into = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], into[:-1] = self._rank(sym[:-1], sym[1:])
            rank[first[1:] - 1] = NONE
        return rank, into

    def _heap(self, sym: list[int]) -> list[int]:
        """The same merges of one long word."""
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            if i >= 0 and after[i] < n and (pair := self.pairs.get((sym[i], sym[after[i]]))):
                heapq.heappush(heap, (pair[0], i, sym[i], sym[after[i]]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = self.pairs[a, b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i])
            push(i)
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = after[i]
        return out

    def _ids(self, word: str, symbols: list[int]) -> bytes:
        """Ids of a word's final symbols; characters that are no piece as bytes.  symbols: negative for unknown ones."""
        out, chars = [], iter([c for c in word if c not in self.symbol])
        for s in symbols:
            if 0 <= s < len(self.pieces):
                out.append(s)
            else:
                c = self.names[s] if s >= 0 else next(chars)
                out += [self.bytes[b] for b in c.encode()]
        return np.array(out, np.int32).tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each of some distinct words, as 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        short, held = [], 0

        def flush() -> None:
            first = np.zeros(len(short) + 1, np.int64)
            np.cumsum([len(words[i]) for i in short], out=first[1:])
            codes = np.frombuffer("".join([words[i] for i in short]).encode("utf-32-le"), np.uint32)
            final, at = self._rounds(self.of_code[codes], first)
            odd = np.logical_or.reduceat((final < 0) | (final >= len(self.pieces)), at[:-1]).tolist()
            raw, at = final.astype(np.int32).tobytes(), at.tolist()
            for k, i in enumerate(short):
                out[i] = self._ids(words[i], final[at[k] : at[k + 1]].tolist()) if odd[k] else raw[4 * at[k] : 4 * at[k + 1]]
            short.clear()

        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._ids(w, self._heap([self.symbol.get(c, -1) for c in w]))
                continue
            short.append(i)
            held += len(w)
            if held >= ROUND_CHARS:
                flush()
                held = 0
        if short:
            flush()
        return out

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each of some distinct texts without spaces that follow a space."""
        split = [self.words.findall(SPACE + p) for p in parts]
        words = list({w for ws in split for w in ws})
        known = dict(zip(words, self.encode_words(words)))
        return [b"".join([known[w] for w in ws]) for ws in split]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        split, odd = [], []
        for i, t in enumerate(texts):
            parts = t.split(" ") if t else []
            # spaces that stand side by side, at an edge or in disguise may merge: such texts go by their words
            if "" in parts or SPACE in t:
                odd.append(i)
                parts = []
            split.append(parts)
        out = self.parts.joined(split)
        if odd:
            for i, ids in zip(odd, self.marked.joined([self.words.findall(SPACE + texts[i].replace(" ", SPACE)) for i in odd])):
                out[i] = ids
        return [np.frombuffer(ids, np.int32) for ids in out]

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: one leading space mark goes, bytes that are no UTF-8 become U+FFFD each."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise ValueError("an id is not in the vocabulary")
        stop = np.flatnonzero(self.kinds[ids] == CONTROL)
        said = ids[self.kinds[ids] != CONTROL]
        n = self.lengths[said]
        begin = np.cumsum(n) - n
        flat = self.flat[np.repeat(self.starts[said] - begin, n) + np.arange(n.sum())]
        # a control id between bytes ends their run
        edges = sorted({0, *(int(begin[k]) for k in (stop - np.arange(len(stop))).tolist() if k < len(said)), len(flat)})
        raw = flat.tobytes()
        text = "".join(raw[a:b].decode("utf-8", "budgetlens_each_byte") for a, b in zip(edges, edges[1:]))
        return text[1:] if len(said) and self.led[said[0]] else text


def encode(df: DataFrame, path: str, text: str = "text", name: str = "ids", end: bool = True) -> DataFrame:
    """df with ``name``, array<int>: the ids of each whole text, and the end id if ``end``.

    path: a SentencePiece model file (BPE with byte fallback and identity normalisation; others raise ValueError).
    A null text counts as an empty one, which has no ids but the end.  Each row stands for itself, so repeated rows and
    null keys are encoded like others; no rows give no rows; a column called ``name`` is replaced.
    """
    _spark.small_batches(df.sparkSession)
    others = [c for c in df.columns if c.lower() not in (text.lower(), name.lower())]
    slim = df.select(text, *others)

    def run(batches):
        model = Pieces.of(path)
        tail = np.array([model.end_id] * end, np.int32)
        for batch in batches:
            _, off = _text.strings(batch.column(0))
            for a, b in _text.slices(off):
                part = batch.slice(a, b - a)
                rows = [np.append(r, tail) for r in model.encode([t or "" for t in part.column(0).to_pylist()])]
                at = np.cumsum([0, *map(len, rows)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    return _spark.mapped(slim, run, f"{fields}, `{name}` array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """df with ``name``: the text of each row's ids.

    Control ids say nothing; a null list of ids has a null text, an empty one an empty text; a null id inside a list
    and an id outside the vocabulary raise ValueError.  Repeated rows are decoded each; no rows give no rows; a column
    called ``name`` is replaced.
    """
    _spark.small_batches(df.sparkSession)
    others = [c for c in df.columns if c.lower() not in (ids.lower(), name.lower())]
    slim = df.select(ids, *others)

    def run(batches):
        model = Pieces.of(path)
        for batch in batches:
            lists = batch.column(0)
            values, at = lists.values, lists.offsets.to_numpy()
            if values.null_count:
                raise ValueError("an id is null")
            flat = values.to_numpy()
            texts = [model.decode(flat[at[i] : at[i + 1]]) if v else None for i, v in enumerate(lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    return _spark.mapped(slim, run, f"{fields}, `{name}` string")


def op13_sentencepiece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the texts that they decode to, as digests."""
    path = _tokens.vocabulary("piece_bpe_32k.model")
    docs = _spark.table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = decode(encode(docs, path).drop("text"), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
