"""Fuzzy line deduplication by MinHash.

Equal lines are one class, known by a 128-bit fingerprint.  Each class has a signature over its character shingles;
its bands are buckets, whose members are verified by exact Jaccard similarity and joined by distributed union-find
(see _links).  One line of each component stays: its first, by document and place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _links, _spark, _text

SHINGLE = 8
PERCENT = 80
#: Bands and values in each: a pair at the threshold meets in one with probability 1 - (1 - 0.8 ** 3) ** 10 = 0.9992.
BANDS, ROWS = 10, 3
#: Four standard deviations under the threshold, for sketches of BANDS * ROWS bytes.
LOOSE = 0.5
BREAK = 10
#: Bytes of text that are worked on at a time, and fingerprints of signed lines that a task remembers.
SLICE_BYTES, SEEN = 1 << 18, 200_000


def line_sets(size: int) -> _links.Sets:
    """Hashed character shingles of texts; shorter texts are one shingle."""

    def sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _text.sets(*_text.character_runs(buf, off, size))

    return sets


def _split(buf: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number, start and end of the lines that take part: those of least characters that are not blank."""
    breaks = np.flatnonzero(buf == BREAK)
    n = len(off) - 1
    owner = np.searchsorted(off, breaks, side="right") - 1
    text_of = np.concatenate([np.arange(n), owner])
    start = np.concatenate([off[:-1], breaks + 1])
    order = np.lexsort((start, text_of))
    text_of, start = text_of[order], start[order]
    end = np.append(start[1:] - 1, off[-1])
    last = np.flatnonzero(np.append(text_of[1:] != text_of[:-1], True)) if len(text_of) else np.zeros(0, int)
    end[last] = off[1:][text_of[last]]
    number = np.arange(len(text_of)) - np.searchsorted(text_of, text_of, side="left")
    own = np.flatnonzero(end > start)
    solid = np.logical_or.reduceat(~_text._SPACE[buf], start[own]) if len(own) else np.zeros(0, bool)
    own = own[solid]
    if least > 1:
        chars = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
        own = own[chars[end[own]] - chars[start[own]] >= least]
    return text_of[own], number[own], start[own], end[own]


def _prints(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of 128-bit fingerprints of spans."""
    raw = buf.tobytes()
    digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())]
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def _unseen(f1: np.ndarray, f2: np.ndarray, seen: set[tuple[int, int]]) -> np.ndarray:
    """Places of the lines that are not in seen, one of equal ones; they are added."""
    if len(seen) > SEEN:
        seen.clear()
    out = []
    for i, line in enumerate(zip(f1.tolist(), f2.tolist())):
        if line not in seen:
            seen.add(line)
            out.append(i)
    return np.array(out, np.int64)


def _made(size: int, least: int):
    """(doc, line, f1, f2, sketch, bands) of all lines; lines that the task has lately signed are not signed again."""

    def run(batches):
        seeds = [int(s) for s in _text.seeds(BANDS * ROWS, 8)]
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            buf, off = _text.strings(batch.column(1))
            for a, b in _text.slices(off, SLICE_BYTES):
                part = buf[off[a] : off[b]]
                text_of, number, start, end = _split(part, off[a : b + 1] - off[a], least)
                f1, f2 = _prints(part, start, end)
                once = _unseen(f1, f2, seen)
                start, end = start[once], end[once]
                spans = np.zeros(len(start) + 1, np.int64)
                np.cumsum(end - start, out=spans[1:])
                joined = part[np.repeat(start - spans[:-1], end - start) + np.arange(spans[-1])]
                sig = _text.minima(*_text.character_runs(joined, spans, size), seeds)
                bands = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
                h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2])
                for k in range(ROWS):
                    h = _text.mix(h * _text._ODD + bands[:, :, k])
                keys = pa.array([r.tobytes() for r in h], pa.binary())
                sketch = pa.array([r.tobytes() for r in (sig & 0xFF).astype(np.uint8)], pa.binary())
                signed = np.full(len(f1), -1)
                signed[once] = np.arange(len(once))
                at = pa.array(signed, mask=signed < 0)
                columns = [batch.column(0).take(pa.array(text_of + a)), pa.array(number), pa.array(f1), pa.array(f2), sketch.take(at), keys.take(at)]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "line", "f1", "f2", "sketch", "bands"])

    return run


def _buckets(batch):
    """(ids, nodes): each line's bands."""
    yield np.repeat(batch.column(0).to_numpy(), BANDS), _links._fixed(batch.column(1)).reshape(-1).view(np.int64)


def _numbered(df: DataFrame, key: str) -> DataFrame | None:
    """df as a written table with a number ``_row`` for each row, if its keys do not tell rows apart; else None."""
    shared = df.groupBy(F.col(key).alias("_shared")).agg(F.count("*").alias("_n")).filter("_shared is null or _n > 1")
    return _spark.written(df.withColumn("_row", F.monotonically_increasing_id())) if shared.limit(1).count() else None


def duplicate_lines(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, least: int = 1) -> DataFrame:
    """A row for each line of df that takes part: key, line, component_key, component_line, kept, n_links, copies.

    Lines are what line feeds divide, numbered from 0; those of fewer than ``least`` characters and blank ones take no
    part.  A line's set holds its runs of ``size`` characters, or the whole of it if it is shorter; lines link from
    ``percent`` hundredths of common over joint members, and equal lines always do.  component_key and component_line
    tell the first line of the component by key and number, and kept that the line is it.  copies counts the equal
    lines, n_links the confirmed links of their class that were needed to find components.  A null text has no lines.
    Rows whose keys are null or repeated are told apart by a number of their own: a row's lines come before those of
    the next row of its key, in no stated order of these rows, and null keys come first.  No rows give no rows; other
    columns are not looked at.
    """
    slim = df.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    numbered = _numbered(slim, "doc")
    if numbered is not None:
        slim = numbered.select(F.struct(F.col("doc").alias("key"), F.col("_row").alias("row")).alias("doc"), "text")
    own = lambda c: F.col(c) if numbered is None else F.col(c)["key"]
    out = _duplicates(slim, size, percent, least)
    return out.select(own("doc").alias(key), "line", own("head").alias("component_key"), F.col("at").alias("component_line"), "kept", "n_links", "copies")


def _duplicates(slim: DataFrame, size: int = SHINGLE, percent: int = PERCENT, least: int = 1) -> DataFrame:
    """(doc, line, head, at, kept, n_links, copies) of slim(doc, text), in which no doc is null or repeated."""
    spark = slim.sparkSession
    _spark.small_batches(spark)
    kind = slim.schema["doc"].dataType.simpleString()
    made = _spark.written(_spark.mapped(slim, _made(size, least), f"doc {kind}, line bigint, f1 bigint, f2 bigint, sketch binary, bands binary"))
    lines = made.select("doc", "line", "f1", "f2")
    classes = lines.groupBy("f1", "f2").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("copies"))
    classes = _spark.written(classes.select("f1", "f2", "first.doc", "first.line", "copies"))
    # a class is known by its first fingerprint, or where two classes share one by the second
    clash = _spark.written(classes.groupBy("f1").agg(F.count("*").alias("c")).filter("c > 1").select("f1", F.lit(True).alias("clash")))
    clear = not clash.limit(1).count()

    def named(rows: DataFrame) -> DataFrame:
        return rows.withColumn("id", F.col("f1")) if clear else rows.join(clash, "f1", "left").withColumn("id", F.when(F.col("clash"), F.col("f2")).otherwise(F.col("f1"))).drop("clash")

    tables = [classes, clash]
    classes = named(classes)
    signed = named(made.filter("sketch is not null"))
    nodes = _links.nodes_of(signed.select("id", "bands"), _buckets, BANDS)
    tables += [nodes.rows, _spark.written(nodes.rows.select("id").distinct())]
    tables.append(_spark.written(_links.picked(signed.select("id", "sketch"), "id", tables[-1]).dropDuplicates(["id"])))
    sketches = tables[-1]

    def texts(ids: DataFrame) -> DataFrame:
        places = _links.picked(classes.select("id", "doc", "line"), "id", ids).dropDuplicates(["id"])
        few = ids.count() <= _links.BROADCAST_IDS
        asked = places.groupBy("doc").agg(F.collect_list(F.struct("id", "line")).alias("asked"))
        parts = slim.join(F.broadcast(asked) if few else asked, "doc").select(F.split("text", "\n").alias("parts"), "asked")
        each = F.explode(F.transform("asked", lambda a: F.struct(a["id"].alias("id"), F.get("parts", a["line"].cast("int")).cast("binary").alias("text"))))
        return parts.select(each.alias("e")).select("e.*")

    large = nodes.part(True) if nodes.large is not None else None
    links, found = _links.link(nodes.part(False), large, sketches, texts, _links.Similarity(line_sets(size), percent, LOOSE))
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    # only classes with links or copies need more than their own first line
    tables.append(_spark.written(_links.picked(classes, "id", found.select("id")).join(found, "id").join(degree, "id", "left")))
    linked = tables[-1]
    heads = linked.groupBy("component").agg(F.min(F.struct("doc", "line")).alias("head"))
    linked = linked.join(heads, "component").select("f1", "f2", F.col("head.doc").alias("hd"), F.col("head.line").alias("hl"), "n_links")
    copied = classes.filter("copies > 1").select("f1", "f2", F.col("doc").alias("cd"), F.col("line").alias("cl"), "copies")
    info = _spark.written(copied.join(linked, ["f1", "f2"], "full").select("f1", "f2", F.coalesce("hd", "cd").alias("hd"), F.coalesce("hl", "cl").alias("hl"), "n_links", "copies"))
    _spark.dropped(*tables)
    nodes.drop()
    out = lines.join(info.hint("shuffle_hash"), ["f1", "f2"], "left")
    head, at = F.coalesce("hd", "doc"), F.coalesce("hl", "line")
    return out.select(
        "doc", "line", head.alias("head"), at.alias("at"), (head.eqNullSafe(F.col("doc")) & (at == F.col("line"))).alias("kept"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"),
    )


def without_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """df with the lines that are not kept taken out of its texts.  Rows that lose all their lines go.

    Rows without any line that takes part (null, empty, blank) stay as they are, as do all other columns, whatever
    they are called.  Each row loses its own lines only, also where keys are null or repeated.
    """
    named = {c: "_key" if c == key else "_new" if c == text else f"_c{i}" for i, c in enumerate(df.columns)}
    slim = df.select(*[F.col(f"`{c}`").alias("_text" if c == text else n) for c, n in named.items()])
    numbered = _numbered(slim, "_key")
    rows = slim if numbered is None else numbered
    doc = F.col("_key") if numbered is None else F.struct(F.col("_key").alias("key"), F.col("_row").alias("row"))
    gone = _duplicates(rows.select(doc.alias("doc"), F.col("_text").alias("text")), **rules).filter("not kept")
    own, is_own = (F.col("doc"), F.col("_key") == F.col("_own")) if numbered is None else (F.col("doc.row"), F.col("_row") == F.col("_own"))
    joined = rows.join(gone.groupBy(own.alias("_own")).agg(F.collect_set("line").alias("_gone")), is_own, "left")
    rest = F.filter(F.split("_text", "\n"), lambda _, i: ~F.array_contains("_gone", i.cast("bigint")))
    kept_text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(rest, "\n"))
    out = joined.withColumn("_new", kept_text).filter(F.col("_gone").isNull() | (F.trim(F.col("_new")) != ""))
    return out.select(*[F.col(n).alias(c) for c, n in named.items()])


def op8_minhash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = duplicate_lines(_spark.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "line", F.col("component_key").alias("component_doc_id"), "component_line", "kept", "copies")


OP8_SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS t FROM split),
own AS (SELECT * FROM lines WHERE regexp_matches(t, '[^ \t\n\x0B\f\r]')),
classes AS (SELECT t, min({'d': doc_id, 'l': line}) AS head, count(*) AS copies FROM own GROUP BY t),
numbered AS (SELECT *, row_number() OVER (ORDER BY head) AS id FROM classes),
bags AS (SELECT id, list_distinct(list_transform(range(1, greatest(length(t) - 7, 1) + 1), lambda i: t[i:i + 7])) AS s FROM numbered),
members AS (SELECT id, len(s) AS n, unnest(s) AS x FROM bags),
common AS (SELECT x, count(*) AS c FROM members GROUP BY x),
-- of two sets that are alike, the rarest members of one meet those of the other
prefixes AS (SELECT id, n, x FROM members JOIN common USING (x) QUALIFY row_number() OVER (PARTITION BY id ORDER BY c, x) <= n - ceil(0.8 * n) + 1),
candidates AS (SELECT DISTINCT a.id AS u, b.id AS v FROM prefixes a JOIN prefixes b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
confirmed AS (SELECT u, v FROM candidates JOIN bags a ON a.id = u JOIN bags b ON b.id = v WHERE 100 * len(list_intersect(a.s, b.s)) >= 80 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
links AS (SELECT u, v FROM confirmed UNION ALL SELECT v, u FROM confirmed),
reach AS (SELECT id, id AS root FROM numbered WHERE id IN (SELECT u FROM links) UNION SELECT l.u, r.root FROM reach r JOIN links l ON l.v = r.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
heads AS (SELECT n.t, n.copies, coalesce(h.head, n.head) AS head FROM numbered n LEFT JOIN roots r ON r.id = n.id LEFT JOIN numbered h ON h.id = r.root)
SELECT o.doc_id, o.line, head.d AS component_doc_id, head.l AS component_line, o.doc_id = head.d AND o.line = head.l AS kept, copies FROM own o JOIN heads USING (t)
"""
