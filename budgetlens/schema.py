"""Record types and constant relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_str, _int, _long, _double = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


QUESTION = _struct(qid=_str, question=_str, answer=_str, gold_docs=T.ArrayType(_str), type=_str, n_supporting=_int, n_sent=_int)
DATASET = _struct(name=_str, kb=T.MapType(_str, _str), questions=T.ArrayType(QUESTION))
_SPAN = _struct(start_token=T.ArrayType(_long), end_token=T.ArrayType(_long))
SHORT_FORM_ROW = _struct(
    document=_struct(tokens=_struct(token=T.ArrayType(_str))),
    question=_struct(text=_str),
    annotations=_struct(short_answers=T.ArrayType(_SPAN), long_answer=T.ArrayType(_struct(start_token=_long, end_token=_long))),
)
MULTI_HOP_ROW = _struct(
    question=_str, answer=_str, type=_str,
    supporting_facts=_struct(title=T.ArrayType(_str), sent_id=T.ArrayType(_int)),
    context=_struct(title=T.ArrayType(_str), sentences=T.ArrayType(T.ArrayType(_str))),
)
RUN_FILE = _struct(ks=T.ArrayType(_int), results=T.ArrayType(_struct(qid=_str, gold=T.ArrayType(_str), ranked=T.ArrayType(_str))))
ALL_RUNS = _struct(**{m: T.MapType(_str, T.ArrayType(_str)) for m in ("dense", "hybrid", "rerank")})
SAMPLE = _struct(qid=_str, question=_str, phase=_str, k=_int, docs=_str, label=_int, ranked=T.ArrayType(_str))
GOLD = T.MapType(_str, T.ArrayType(_str))

# Strategies by rising cost, ladders, the routing map, cumulative stage latencies in milliseconds, and
# the thresholds of the policy sweep.
STRATEGIES7 = (("dense@3", "dense", 3), ("dense@5", "dense", 5), ("hybrid@5", "hybrid", 5), ("hybrid@10", "hybrid", 10), ("rerank@10", "rerank", 10), ("hybrid@20", "hybrid", 20), ("rerank@20", "rerank", 20))
STRATEGIES8 = (("dense@3", "dense", 3), ("dense@5", "dense", 5), ("dense@10", "dense", 10), ("hybrid@5", "hybrid", 5), ("hybrid@10", "hybrid", 10), ("rerank@10", "rerank", 10), ("hybrid@20", "hybrid", 20), ("rerank@20", "rerank", 20))
LADDER_A = (("dense@3", "dense", 3), ("hybrid@5", "hybrid", 5), ("hybrid@10", "hybrid", 10), ("rerank@10", "rerank", 10), ("rerank@20", "rerank", 20))
LADDER_B = (("dense@10", "dense", 10), ("hybrid@10", "hybrid", 10), ("rerank@10", "rerank", 10), ("rerank@20", "rerank", 20))
LADDER_3 = (("dense@3", "dense", 3), ("hybrid@5", "hybrid", 5), ("rerank@20", "rerank", 20))
LADDERS = {"A": LADDER_A, "B": LADDER_B, "3": LADDER_3}
FIXED = ("dense@10", "hybrid@10", "rerank@10", "rerank@20")
ROUTES = {"easy": "dense@3", "medium": "dense@5", "hard": "hybrid@20"}
STAGE_MS = {"dense": 31.5, "hybrid": 93.5, "rerank": 220.9}
CRITIC_MS = 4.7
KS = (3, 5, 10, 20)
GLOBAL_THRESHOLDS = (0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
DENSE_THRESHOLDS = (0.55, 0.65, 0.75, 0.85, 0.95)
HYBRID_THRESHOLDS = (0.35, 0.45, 0.55, 0.65, 0.75)
RECALL_FLOOR = 0.94

Strategies = tuple[tuple[str, str, int], ...]


def strategies(spark: SparkSession, rows: Strategies) -> DataFrame:
    """(level, name, method, k), level from 1 in order of cost."""
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "level int, name string, method string, k int")


def stage_latencies(spark: SparkSession, ms: dict[str, float] = STAGE_MS) -> DataFrame:
    return spark.createDataFrame([(m, float(v)) for m, v in ms.items()], "method string, ms double")


def configurations() -> list[tuple[int, str, float, float]]:
    """(order, name, dense threshold, hybrid threshold) of the sweep: one threshold for both, then the grid."""
    same = [(f"t={t:.2f}", t, t) for t in GLOBAL_THRESHOLDS]
    grid = [(f"d{d}/h{h}", d, h) for d in DENSE_THRESHOLDS for h in HYBRID_THRESHOLDS]
    return [(i + 1, *c) for i, c in enumerate(same + grid)]


def configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(configurations(), "config_ord int, config string, t_dense double, t_hybrid double")
