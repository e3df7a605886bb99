"""Which documents contain which passages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passages that one pass over the documents looks for, and their characters.
BLOCK_PASSAGES, BLOCK_CHARS = 1 << 16, 8 << 20
#: Characters of a passage that the automaton knows; the rest is compared where they occur.
HEAD = 24
#: Texts that a task is sent at a time, and that it holds as Python strings.
ROWS, SLICE = 1000, 256


def _blocks(passages: DataFrame):
    block, held = [], 0
    for r in passages.select("item_id", "text").filter("text <> ''").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        held += len(r["text"])
        if len(block) >= BLOCK_PASSAGES or held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def _automaton(block):
    import ahocorasick

    out = ahocorasick.Automaton()
    heads: dict[str, list] = {}
    for item_id, passage in block:
        heads.setdefault(passage[:HEAD], []).append((item_id, passage))
    for head, held in heads.items():
        out.add_word(head, (len(head), held))
    out.make_automaton()
    return out


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(item_id, doc_id) where the text of docs(doc_id, text) contains that of passages(item_id, text).

    The passages are a stated set; they meet all documents in blocks of bounded size, and a text is read once for all
    passages of a block.  Empty passages match nothing.
    """
    spark = docs.sparkSession
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ROWS:
        spark.conf.set(rows, str(ROWS))
    out = spark.createDataFrame([], "item_id bigint, doc_id bigint")
    for block in _blocks(passages):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            automaton = _automaton(sent.value)
            for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
                items, found = [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = {}
                    for last, (n, held) in automaton.iter(text or ""):
                        for k, (item_id, passage) in enumerate(held):
                            if text.startswith(passage, last + 1 - n):
                                own[n, k, passage] = item_id
                    items += own.values()
                    found += [doc_id] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(found, pa.int64())], ["item_id", "doc_id"])

        out = out.union(docs.select("doc_id", "text").mapInArrow(run, "item_id bigint, doc_id bigint"))
    return out
