"""Retrieval for questions that arrive as a stream.

Ranking needs a window over a question's candidates, which streams do not have; each micro-batch is therefore ranked
as a batch.  A batch is written under its number, so one that is repeated after a failure overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.lexical import Index, bm25_topk


def search_stream(questions: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts writing search(batch) of a streaming questions(qid, question) to path, a folder for each batch."""

    def one(batch: DataFrame, number: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def bm25_stream(questions: DataFrame, index: Index, k: int, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return search_stream(questions, lambda batch: bm25_topk(batch, index, k), path, checkpoint, **trigger)
