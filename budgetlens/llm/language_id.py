"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become sequences of lower-cased letters in which every run of other characters is one mark; n-grams of 1 to 4
such characters are hashed into a fixed number of cells.  Training counts cells by language in Spark; the matrix of
log-probabilities (cells x languages) goes to the workers, which score whole texts by gathering and summing rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark, _text

UNKNOWN = "und"
#: Cells of the hashed n-grams.  The matrix that is sent out holds four bytes of each for each language.
CELLS = 1 << 15
#: Languages that are counted or scored at a time, so that a worker's memory depends on their number by the matrix only.
BLOCK = 16
ORDERS = (1, 2, 3, 4)


def _letters() -> np.ndarray:
    """Code point to lower-cased letter, 0 for what is no letter."""
    cache = _spark.worker_cache()
    if "letters" not in cache:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        cache["letters"] = table
    return cache["letters"]


def _symbols(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and marks of all texts in a row, first one of each text, number of letters of each text."""
    # a mark between texts is made by the NUL that stands for each text's end
    raw = buf.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    codes = np.frombuffer("\0".join(["", *[t + "\0" for t in texts]]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = _letters()[codes]
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=first[1:])
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
    keep[first[:-1]] = True
    kept = np.zeros(len(sym) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    letters = np.zeros(len(sym) + 1, np.int64)
    np.cumsum(sym != 0, out=letters[1:])
    return sym[keep], kept[first], letters[first[1:]] - letters[first[:-1]]


def cells(sym: np.ndarray, first: np.ndarray):
    """For each order the cells of the n-grams that end at each symbol; -1 where one would begin in another text."""
    group = np.repeat(first[:-1], np.diff(first))
    place = np.arange(len(sym)) - group
    h = np.zeros(len(sym), np.uint64)
    x = sym.astype(np.uint64) + np.uint64(1)
    for n in ORDERS:
        if n == 1:
            h = x * _text._ODD
        else:
            h = h.copy()
            h[1:] = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _text._M1 + x[1:] * _text._ODD
        c = (_text.mix(h + np.uint64(n)) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)
        c[place < n - 1] = -1
        yield c


class Model:
    """Languages and their log-probabilities: weights[cell, language]."""

    def __init__(self, languages: list[str], weights: np.ndarray) -> None:
        self.languages, self.weights = languages, weights

    @classmethod
    def of(cls, languages: list[str], counts: np.ndarray, alpha: float = 0.1) -> Model:
        """From counts[cell, language], smoothed by alpha."""
        total = counts.sum(0, keepdims=True)
        return cls(languages, np.log((counts + alpha) / (total + alpha * CELLS)).astype(np.float32))

    def score(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predicted language (index, -1: no letter) and score of each text."""
        n = len(off) - 1
        if not self.languages:
            return np.full(n, -1), np.zeros(n)
        sym, first, letters = _symbols(buf, off)
        sums = np.zeros((n, len(self.languages)))
        for c in cells(sym, first):
            for a in range(0, len(self.languages), BLOCK):
                rows = self.weights[:, a : a + BLOCK][np.maximum(c, 0)]
                rows[c < 0] = 0
                sums[:, a : a + BLOCK] += np.add.reduceat(rows, first[:-1], axis=0, dtype=np.float64)
        grams = np.maximum(np.diff(first) * len(ORDERS), 1)
        # neighbouring n-grams are not independent: the evidence counts with the root of its number
        scaled = sums / np.sqrt(grams)[:, None]
        scaled -= scaled.max(1, keepdims=True)
        p = np.exp(scaled)
        best = p.argmax(1)
        score = p[np.arange(n), best] / p.sum(1)
        return np.where(letters > 0, best, -1), np.where(letters > 0, score, 0.0)


def count_cells(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, cell, n) over all rows of df; each batch, or slice of one with many languages, is combined before anything is sent."""

    def counted(names, key, n):
        return pa.RecordBatch.from_arrays([pa.array(names[key // CELLS], pa.string()), pa.array(key % CELLS), pa.array(n)], ["lang", "cell", "n"])

    def run(batches):
        for batch in batches:
            buf, off = _text.strings(batch.column(0))
            named: dict[str, int] = {}
            code = np.array([named.setdefault(lg, len(named)) for lg in batch.column(1).to_pylist()], np.int64)
            names = np.array(list(named), dtype=object)
            few = len(named) <= BLOCK
            held = np.zeros(len(named) * CELLS if few else 0, np.int64)
            for a, b in _text.slices(off):
                sym, first, _ = _symbols(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                base = np.repeat(code[a:b] * CELLS, np.diff(first))
                for c in cells(sym, first):
                    key = (base + c)[c >= 0]
                    if few:
                        held += np.bincount(key, minlength=len(held))
                    else:
                        yield counted(names, *np.unique(key, return_counts=True))
            if few:
                at = np.flatnonzero(held)
                yield counted(names, at, held[at])

    return _spark.mapped(df.select(F.col(text).alias("text"), F.col(lang).alias("lang")), run, "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 20_000) -> Model:
    """A model from the rows of df that have a text and a language.

    sample_rows: about so many rows of each language are used, picked by a hash of their keys; all where there are
    fewer.  It bounds the cost of training; the texts that are picked are counted whole.
    Any number of languages will do; the driver and each worker hold 128 KB for each.
    """
    _spark.small_batches(df.sparkSession)
    labelled = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    shares = [(lg, int((1 << 30) * min(1.0, sample_rows / n))) for lg, n in sizes.items()]
    told = F.broadcast(df.sparkSession.createDataFrame(shares, "lang string, share bigint"))
    picked = labelled.join(told, "lang").filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < F.col("share"))
    # a language without a picked text has no counts
    model = Model.of(languages, np.broadcast_to(np.float32(0), (CELLS, max(1, len(languages)))))
    place = {lg: j for j, lg in enumerate(languages)}
    for r in count_cells(picked, "text", "lang").groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells")).toLocalIterator():
        counts = np.zeros((CELLS, 1))
        at, n = np.array(r["cells"], np.int64).T
        counts[at, 0] = n
        model.weights[:, place[r["lang"]]] = Model.of([r["lang"]], counts).weights[:, 0]
    return model


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """A row for each row of df: key, the columns of keep, and under names the language and its score (0 to 1).

    A null text, one without a letter, and every text if the model knows no language get ``und`` and score 0.
    Whole texts are read, however long; equal texts get equal rows; other columns are never looked at.
    """
    spark = df.sparkSession
    _spark.small_batches(spark)
    sent = spark.sparkContext.broadcast((model.languages, model.weights))
    slim = df.select(F.col(text).alias("_text"), F.col(key), *keep)

    def run(batches):
        m = Model(*sent.value)
        for batch in batches:
            buf, off = _text.strings(batch.column(0))
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for a, b in _text.slices(off):
                x, y = m.score(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                best.append(x)
                score.append(y)
            known = np.array([*m.languages, UNKNOWN], dtype=object)
            columns = [pa.array(known[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:])
    return _spark.mapped(slim, run, f"{fields}, `{names[0]}` string, `{names[1]}` double")


def held_out(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def op5_language_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spark.table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out("doc_id")))
    return predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
