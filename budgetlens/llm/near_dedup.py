"""Near-duplicate documents by a chosen-path similarity join.

Each document's set of word shingles is embedded as TOKENS MinHash values, of which any two sets share a fraction equal
to their similarity.  Each tree branches documents recursively: at a node one or two of the tokens are chosen, 1/0.8 on
average, and a document goes to the child that each of its chosen values names, so a pair at the threshold shares one
child a level on average.  A node of a few documents is a leaf, whose members are compared exhaustively; larger ones
branch on, to a depth at which only families of alike documents are left (see _links for these).  Independent trees
bring the recall to its target: one tree keeps a pair of similarity 0.8 together to the last level with probability
0.57 at least, so TREES trees miss it with about (1 - 0.57) ** TREES.  Links are confirmed on whole sets.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _links, _spark, _text

WORDS = 4
PERCENT = 80
TOKENS, TREES, DEPTH = 64, 10, 4
#: Share of equal sketch bytes from which a pair is verified: four standard deviations under the threshold.
LOOSE = 0.6


def word_sets(size: int) -> _links.Sets:
    def sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, first = _text.word_hashes(_text.lower(buf), off)
        return _text.sets(*_text.shingle_runs(h, first, size))

    return sets


def _prints(buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> list[bytes]:
    """SHA-256 of each text's words, A-Z lowered, with a space behind each: equal for equal sequences only."""
    n = end - start + 1
    at = np.cumsum(n) - n
    # all words with the byte behind them, which is then made a space
    flat = np.concatenate([buf, np.zeros(1, np.uint8)])[np.repeat(start - at, n) + np.arange(n.sum())]
    flat[at + n - 1] = 0x20
    edge = np.append(at, len(flat))[first].tolist()
    raw = flat.tobytes()
    return [hashlib.sha256(raw[a:b]).digest() for a, b in zip(edge, edge[1:])]


def _embedded(size: int):
    """(id, n, print, tokens) of (id, text): the set's size, the digest of the words, and the MinHash values."""

    def run(batches):
        seeds = [int(s) for s in _text.seeds(TOKENS, 3)]
        for batch in batches:
            buf, off = _text.strings(batch.column(1))
            n, prints, tokens = [np.zeros(0, np.int64)], [], []
            for a, b in _text.slices(off):
                part, at = _text.lower(buf[off[a] : off[b]]), off[a : b + 1] - off[a]
                start, end, first = _text.words(part, at)
                v, at = _text.sets(*_text.shingle_runs(_text.hash_spans(_text.prefix(part), start, end), first, size))
                n.append(np.diff(at))
                prints += _prints(part, start, end, first)
                tokens += [r.tobytes() for r in _text.minima(v, at, seeds)]
            columns = [pa.array(np.concatenate(n)), pa.array(prints, pa.binary()), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n", "print", "tokens"])

    return run


def _children(node: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child): the children of each (node, document's tokens) row."""
    x = _text.mix(node ^ _text._ODD)
    first = (x % np.uint64(TOKENS)).astype(np.int64)
    second = ((x >> np.uint64(16)) % np.uint64(TOKENS - 1)).astype(np.int64)
    second = np.where(second >= first, second + 1, second)
    two = np.flatnonzero((x >> np.uint64(40)) % np.uint64(100) < 100 * 100 // PERCENT - 100)
    rows = np.concatenate([np.arange(len(node)), two])
    place = np.concatenate([first, second[two]])
    value = tokens[rows, place].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))
    return rows, _text.mix(_text.mix(node[rows]) + value * _text._ODD)


def _tokens(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(_links._fixed(column)).view(np.uint32).reshape(-1, TOKENS)


def _paths(trees: int, large: list):
    """(ids, nodes) of (id, tokens): the first level of all trees, or the one below the large nodes of those before it."""

    def entries(batch):
        ids, tokens = batch.column(0).to_numpy(), _tokens(batch.column(1))
        for t in range(trees):
            rows, node = _children(np.full(len(ids), t + 1, np.uint64), tokens)
            for sent in large:
                at = np.minimum(np.searchsorted(sent.value, node), len(sent.value) - 1)
                rows = rows[mine := sent.value[at] == node]
                own, node = _children(node[mine], tokens[rows])
                rows = rows[own]
            yield ids[rows], node.view(np.int64)

    return entries


def _branches(batch):
    """(ids, nodes) of (id, node, tokens): the next level."""
    ids = batch.column(0).to_numpy()
    rows, child = _children(batch.column(1).to_numpy().view(np.uint64), _tokens(batch.column(2)))
    yield ids[rows], child.view(np.int64)


def _sketch(batches):
    for batch in batches:
        low = (_tokens(batch.column(1)) & 0xFF).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in low], pa.binary())], ["id", "sketch"])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, trees: int = TREES) -> DataFrame:
    """A row for each row of df: key, n_shingles, component_id, kept, n_links.

    Words are what white space (space, codes 9 to 13) divides, A-Z lowered.  A document's set holds its runs of
    ``words`` words, or all its words as one where they are fewer; documents link from ``percent`` hundredths of
    common over joint members.  Documents of equal words are one class.  component_id is the smallest key that links
    reach, kept says that the row is the one that stays.  A null, empty or blank text has no members, links with nothing
    and is kept.  n_links counts the confirmed links of the document's class to other classes that were needed to find
    components.  Rows that share a key are documents of their own, told apart by a number: of those of a component one
    is kept, in no stated order.  Null keys link with nothing, get a null component and are kept.  Keys are integers.
    No rows give no rows; other columns are not looked at.
    """
    slim = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    numbered = _numbered(slim, "id")
    if numbered is None:
        out = _near_duplicates(slim, words, percent, trees)
    else:
        out = _row_results(numbered, words, percent, trees).drop("_row")
    return out.withColumnRenamed("id", key)


def without_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, trees: int = TREES) -> DataFrame:
    """The rows of df that near_duplicates() keeps, with all their columns, whatever these are called."""
    row = _spark.free(df, "row")[0]
    numbered = _numbered(df, key, row)
    if numbered is None:
        own, told = key, near_duplicates(df, key, text, words, percent, trees).withColumnRenamed(key, "id")
    else:
        slim = numbered.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), F.col(row).alias("_row"))
        own, told = row, _row_results(slim, words, percent, trees).select(F.col("_row").alias("id"), "kept")
    gone = _spark.written(told.filter("not kept").select("id"))
    few = gone.count() <= _links.BROADCAST_IDS
    rows = df if numbered is None else numbered
    return rows.join(F.broadcast(gone) if few else gone, F.col(f"`{own}`") == gone["id"], "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def _numbered(df: DataFrame, key: str, name: str = "_row") -> DataFrame | None:
    """df as a written table with a number for each row, if keys other than null repeat; else None."""
    shared = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_shared")).agg(F.count("*").alias("_n")).filter("_n > 1")
    return _spark.written(df.withColumn(name, F.monotonically_increasing_id())) if shared.limit(1).count() else None


def _row_results(numbered: DataFrame, words: int, percent: int, trees: int) -> DataFrame:
    """near_duplicates() of written rows(id, text, _row), with _row: rows link as documents of their own."""
    told = _spark.written(_near_duplicates(numbered.select(F.when(F.col("id").isNotNull(), F.col("_row")).alias("id"), "text"), words, percent, trees))
    rows = _spark.written(told.filter("id is not null").withColumnRenamed("id", "_row").join(numbered.select("id", "_row"), "_row"))
    # rows that are alone are their own heads, so only components of several rows are looked up
    heads = rows.groupBy("component_id").agg(F.min(F.struct("id", "_row")).alias("head"), F.count("*").alias("c")).filter("c > 1")
    heads = _spark.written(heads)
    out = _links.left_join(rows, heads.select("component_id", "head"), "component_id", heads.filter(F.col("c") > _links.HOT))
    first = F.coalesce("head._row", "_row")
    out = out.select("_row", "id", "n_shingles", F.coalesce("head.id", "id").alias("component_id"), (first == F.col("_row")).alias("kept"), "n_links")
    return out.union(told.filter("id is null").select(F.lit(None).cast("bigint").alias("_row"), "id", "n_shingles", "component_id", "kept", "n_links"))


def _near_duplicates(slim: DataFrame, words: int, percent: int, trees: int) -> DataFrame:
    """near_duplicates() of slim(id, text), in which no id but null is repeated."""
    _spark.small_batches(slim.sparkSession)
    made = _spark.written(_spark.mapped(slim, _embedded(words), "id bigint, n bigint, print binary, tokens binary"))
    alike = made.filter("n > 0 and id is not null").groupBy("print").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
    alike = _spark.written(alike)
    hot = alike.filter(F.col("copies") > _links.HOT)
    # texts without words are alone, so they do not meet anywhere
    classed = _links.left_join(made.filter("n > 0"), alike.select("print", "rep"), "print", hot).select("id", "n", "rep", "tokens")
    classed = classed.union(made.filter("n = 0").select("id", "n", F.lit(None).cast("bigint").alias("rep"), "tokens"))
    rep = F.coalesce("rep", "id")
    docs = _spark.written(classed.select("id", "n", F.when(F.col("id").isNotNull(), rep).alias("rep"), F.when(rep == F.col("id"), F.col("tokens")).alias("tokens")))
    _spark.dropped(made)
    reps = _spark.written(docs.filter("id = rep and n > 0").select("id", "tokens"))
    share = 100 / PERCENT
    levels, large = [_links.nodes_of(reps, _paths(trees, []), trees * share)], []
    while len(levels) < DEPTH and levels[-1].large is not None:
        last = levels[-1]
        if last.few and len(large) == len(levels) - 1:  # documents find their way down again, none moves for it
            large.append(last.sent())
            levels.append(_links.nodes_of(reps, _paths(trees, list(large)), share, total=last.members * share))
        else:
            levels.append(_links.nodes_of(last.part(True).join(reps, "id").select("id", "node", "tokens"), _branches, share, total=last.members * share))
    leaves = reduce(DataFrame.union, [n.part(False) for n in levels])
    large = levels[-1].part(True) if levels[-1].large is not None else None
    sketches = _spark.mapped(reps, _sketch, "id bigint, sketch binary")

    def texts(ids: DataFrame) -> DataFrame:
        return _links.picked(slim, "id", ids).select("id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    links, found = _links.link(leaves, large, sketches, texts, _links.Similarity(word_sets(words), percent, LOOSE))
    _spark.dropped(reps)
    for n in levels:
        n.drop()
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    info = _spark.written(found.withColumnRenamed("id", "rep").join(degree, "rep", "left").select("rep", "component", "n_links"))
    out = _links.left_join(docs, info, "rep", hot)
    component = F.coalesce("component", "rep")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def op3_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_spark.table(spark, sf_dir, "documents")).drop("n_links")


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
bags AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
sized AS (SELECT doc_id, len(s) AS n, s FROM bags),
members AS (SELECT doc_id, n, unnest(s) AS x FROM sized),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM members a JOIN members b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.u, r.root FROM reach r JOIN links l ON l.v = r.doc_id),
roots AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN roots USING (doc_id)
"""
