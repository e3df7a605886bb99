"""A sufficiency critic that reads question and documents.

Its features are words in a hashed space: the question's words that the documents have and those that they lack, its
word pairs, how large a share of both is met, and all of these shares by stage.  Training is synchronous: each step
takes one mini-batch, every task sums the gradient of its own rows, sums of tasks meet cell by cell in a shuffle, and
the driver, which holds the weights (a fixed number of cells), makes one step of Adam with weight decay, a warm-up of
a fifth of an epoch and a linear decline.  After each epoch the validation F1 is taken; the best epoch's weights stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import critic

#: Cells of the hashed space; the last one is the bias.
CELLS = 1 << 16
EPOCHS, BATCHES, RATE, DECAY = 4, 8, 0.05, 0.01
BINS = 10


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * BINS / whole)).otherwise(-1).cast("string")


def features(rows: DataFrame) -> DataFrame:
    """rows with ``cells``: the distinct cells of a sample's features, in the JVM."""
    pairs_of = lambda t: F.transform(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(t, i + 1)))
    base = rows.withColumn("_q", X.tokens(F.col("question"))).withColumn("_d", X.tokens(F.col("docs")))
    base = base.withColumn("_qw", F.array_distinct("_q")).withColumn("_qp", F.array_distinct(pairs_of(F.col("_q")))).withColumn("_dp", F.array_distinct(pairs_of(F.col("_d")))).withColumn("_dw", F.array_distinct("_d"))
    met, met_pairs = F.array_intersect("_qw", "_dw"), F.array_intersect("_qp", "_dp")
    base = base.withColumn("_m", met).withColumn("_mp", met_pairs)
    words, pairs = _share(F.size("_m"), F.size("_qw")), _share(F.size("_mp"), F.size("_qp"))
    named = lambda name, c: F.transform(c, lambda w: F.concat(F.lit(name), w))
    one = lambda *parts: F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    shapes = F.array(one("w", words), one("p", pairs), one("wp", words, pairs), one("sw", F.col("phase"), words), one("sp", F.col("phase"), pairs), one("s", F.col("phase")), one("l", F.floor(F.log2(F.size("_d") + F.lit(1))).cast("string")), one("n", F.size("_qw").cast("string")))
    said = F.concat(shapes, named("+", F.col("_m")), named("-", F.array_except("_qw", "_m")), named("++", F.col("_mp")))
    cells = F.array_distinct(F.transform(said, lambda s: F.pmod(F.xxhash64(s), F.lit(CELLS - 1)).cast("int")))
    return base.withColumn("cells", cells).drop("_q", "_d", "_qw", "_qp", "_dp", "_dw", "_m", "_mp")


def probabilities(weights: np.ndarray, cells: pa.ListArray) -> np.ndarray:
    """The model's probability of each row of cells."""
    off = cells.offsets.to_numpy()
    flat = weights[cells.values.to_numpy()[off[0] : off[-1]]] if len(cells) else np.zeros(0)
    sums = np.concatenate([[0.0], np.cumsum(flat)])
    z = sums[off[1:] - off[0]] - sums[off[:-1] - off[0]] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradient(weights: np.ndarray, cells: pa.ListArray, labels: np.ndarray) -> np.ndarray:
    """The sum of the rows' gradients of the logistic loss, over all cells."""
    gap = probabilities(weights, cells) - labels
    off = cells.offsets.to_numpy()
    out = np.zeros(len(weights))
    np.add.at(out, cells.values.to_numpy()[off[0] : off[-1]], np.repeat(gap, np.diff(off)))
    out[-1] = gap.sum()
    return out


class Adam:
    def __init__(self, size: int, rate: float, decay: float, steps: int, warm: int) -> None:
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0
        self.rate, self.decay, self.steps, self.warm = rate, decay, steps, warm

    def step(self, weights: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        rate = self.rate * min(self.t / max(1, self.warm), max(0.0, (self.steps - self.t + 1) / max(1, self.steps - self.warm)))
        move = (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
        return weights - rate * (move + self.decay * weights)


@dataclass
class Model:
    weights: np.ndarray
    f1: float = 0.0
    epoch: int = -1

    def write(self, spark: SparkSession, path: str) -> None:
        at = np.flatnonzero(self.weights)
        rows = [(int(c), float(w), self.f1, self.epoch) for c, w in zip(at, self.weights[at])] or [(0, 0.0, self.f1, self.epoch)]
        spark.createDataFrame(rows, "cell int, w double, f1 double, epoch int").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Model:
        rows = spark.read.parquet(path).collect()  # at most CELLS
        weights = np.zeros(CELLS)
        for r in rows:
            weights[r["cell"]] = r["w"]
        return cls(weights, rows[0]["f1"], rows[0]["epoch"])


def _gradients(batch_rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """The mean gradient of rows(cells, label) and their number."""
    sent = batch_rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        total, n = np.zeros(CELLS), 0
        for batch in batches:
            total += gradient(sent.value, batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
            n += len(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], float(n)))], ["cell", "g"])

    sums = batch_rows.select("cells", "label").mapInArrow(run, "cell int, g double").groupBy("cell").agg(F.sum("g").alias("g")).toArrow()
    sent.destroy()
    cell, g = sums["cell"].to_numpy(), sums["g"].to_numpy()
    n = int(g[cell == -1].sum())
    out = np.zeros(CELLS)
    out[cell[cell >= 0]] = g[cell >= 0]
    return out / max(1, n), n


def scored(model: Model, rows: DataFrame) -> DataFrame:
    """rows(question, docs, phase, ...) with p."""
    sent = rows.sparkSession.sparkContext.broadcast(model.weights)
    told = features(rows)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = rows.columns

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(probabilities(sent.value, batch.column(0)))], [*names, "p"])

    return told.select("cells", *names).mapInArrow(run, f"{kinds}, p double")


def f1(model: Model, rows: DataFrame) -> float:
    """F1 of label 1 at one half."""
    yes, told = F.col("label") == 1, F.col("p") >= 0.5
    n = scored(model, rows).agg(F.count_if(told & yes).alias("tp"), F.count_if(told | yes).alias("any")).first()
    return 2 * n["tp"] / (n["any"] + n["tp"]) if n["any"] + n["tp"] else 0.0


def train(train_rows: DataFrame, val_rows: DataFrame, epochs: int = EPOCHS, batches: int = BATCHES, rate: float = RATE, decay: float = DECAY) -> Model:
    """The weights of the epoch of largest validation F1, the first of equal ones.  Rows without documents are left out.

    train_rows, val_rows: critic.samples().  Batches are told by a hash of question, stage and epoch, so each row is in
    one batch of each epoch, and another one each time.
    """
    rows = features(critic.usable(train_rows)).select("qid", "phase", "label", "cells").persist()
    held = val_rows.persist()
    steps = epochs * batches
    weights, adam, best = np.zeros(CELLS), Adam(CELLS, rate, decay, steps, batches // 5), Model(np.zeros(CELLS), -1.0)
    for epoch in range(epochs):
        for b in range(batches):
            grad, n = _gradients(rows.filter(F.pmod(F.xxhash64("qid", "phase", F.lit(epoch)), F.lit(batches)) == b), weights)
            if n:
                weights = adam.step(weights, grad)
        now = f1(Model(weights), held)
        if now > best.f1:
            best = Model(weights.copy(), now, epoch)
    rows.unpersist()
    held.unpersist()
    return best
