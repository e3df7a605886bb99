"""Aggregates over coverage and decisions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import files

_share = lambda c: F.avg(c.cast("int"))


def recall_matrix(cov: DataFrame, *groups: str) -> DataFrame:
    """(groups, method, k, n_queries, recall, hit_rate, full_rate) of coverage rows."""
    return cov.groupBy(*groups, "method", "k").agg(F.count("*").alias("n_queries"), F.avg("cov").alias("recall"), _share(F.col("n_hit") > 0).alias("hit_rate"), _share(F.col("full")).alias("full_rate"))


def recall_pivot(cov: DataFrame, ks: tuple[int, ...], *groups: str) -> DataFrame:
    """A row for each group and method, a column r<k> for each k."""
    return cov.groupBy(*groups, "method").pivot("k", list(ks)).agg(F.avg("cov")).select(*groups, "method", *[F.col(str(k)).alias(f"r{k}") for k in ks])


def shares(df: DataFrame, value: str, classes: tuple[str, ...], *groups: str) -> DataFrame:
    """(groups, value, n, share) of a category; classes that do not occur have 0."""
    sums = [F.count(F.when(F.col(value) == c, 1)).alias(f"_{i}") for i, c in enumerate(classes)]
    wide = df.groupBy(*groups).agg(F.count("*").alias("_all"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias(value), F.col(f"_{i}").alias("n")) for i, c in enumerate(classes)]))
    return wide.select(*groups, "_all", each.alias("e")).select(*groups, f"e.{value}", "e.n", X.ratio(F.col("e.n"), F.col("_all")).alias("share"))


def confusion(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(phase, tp, fp, fn, tn, precision, recall, f1, accuracy, sufficiency) of scores(phase, p, label)."""
    pos, yes = F.col("p") >= threshold, F.col("label") == 1
    counts = scores.groupBy("phase").agg(*[F.count_if(c).alias(n) for n, c in (("tp", pos & yes), ("fp", pos & ~yes), ("fn", ~pos & yes), ("tn", ~pos & ~yes))])
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    out = counts.withColumn("precision", X.ratio(tp, tp + fp)).withColumn("recall", X.ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", X.ratio(2 * p * r, p + r)).withColumn("accuracy", X.ratio(tp + tn, tp + fp + fn + tn)).withColumn("sufficiency", X.ratio(tp + fn, tp + fp + fn + tn))


#: Values of a group from which its median is sought by histograms, bins of one, and rounds at most.
MANY, BINS, MEDIAN_ROUNDS = 10_000, 256, 80


def medians(samples: DataFrame, value: str, *groups: str, many: int = MANY) -> DataFrame:
    """(groups, median): exact medians; null and values that are not finite are left out.

    A group of up to ``many`` values is sorted where it meets.  In a larger one histograms narrow the interval in which
    its middle values lie, bin by bin, until few values or a single one are left, so no task ever holds a group.
    """
    v = F.col(value).cast("double")
    rows = samples.select(*groups, v.alias("_v")).filter((F.col("_v") < math.inf) & (F.col("_v") > -math.inf))  # NaN is above infinity
    sizes = files.kept(rows.groupBy(*groups).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    large = sizes.filter(F.col("_n") > many)

    def of(part: DataFrame, targets: DataFrame) -> DataFrame:
        """part's rows with the targets of their group; targets are at most two for each ``many`` rows."""
        t = F.broadcast(targets.toDF(*[f"_g{i}" for i in range(len(groups))], *targets.columns[len(groups) :]))
        on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
        return part.join(t, on or F.lit(True)).drop(*[f"_g{i}" for i in range(len(groups))])

    # each target seeks the value of a rank: below values of its group are under its interval [lo, hi]
    ranks = F.explode(F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))))
    targets = large.select(*groups, ranks.alias("_rank"), F.lit(0).cast("bigint").alias("_below"), "_lo", "_hi", "_n")
    found = None
    for _ in range(MEDIAN_ROUNDS):
        done = files.kept(targets.filter((F.col("_lo") == F.col("_hi")) | (F.col("_n") <= many)))
        targets = files.kept(targets.filter((F.col("_lo") < F.col("_hi")) & (F.col("_n") > many)))
        found = done if found is None else found.union(done)
        if not targets.limit(1).count():
            break
        within = of(rows, targets.select(*groups, "_rank", "_below", "_lo", "_hi")).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        # halves first, so that the width cannot overflow
        place = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        bins = within.withColumn("_bin", F.least(F.lit(BINS - 1), F.floor(place * BINS))).groupBy(*groups, "_rank", "_below", "_bin").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_n").over(Window.partitionBy(*groups, "_rank").orderBy("_bin"))  # at most BINS rows
        targets = bins.withColumn("_upto", F.col("_below") + upto).withColumn("_below", F.col("_upto") - F.col("_n")).filter((F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto"))).select(*groups, "_rank", "_below", "_lo", "_hi", "_n")
    single = found.filter(F.col("_lo") == F.col("_hi")).select(*groups, "_rank", F.col("_lo").alias("_m"))
    few = of(rows, found.filter(F.col("_lo") < F.col("_hi")).select(*groups, "_rank", "_below", "_lo", "_hi")).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    few = few.groupBy(*groups, "_rank", "_below").agg(F.array_sort(F.collect_list("_v")).alias("_l")).select(*groups, "_rank", F.element_at("_l", (F.col("_rank") - F.col("_below") + 1).cast("int")).alias("_m"))
    middle = single.union(few).groupBy(*groups).agg((F.min("_m") / 2 + F.max("_m") / 2).alias("_half"), F.min("_m").alias("_a"), F.max("_m").alias("_b"))
    middle = middle.select(*groups, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_half")).alias("median"))
    names = [f"_g{i}" for i in range(len(groups))]
    on = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(groups, names)]
    rest = rows.join(F.broadcast(large.select(*[F.col(g).alias(n) for g, n in zip(groups, names)], F.lit(1).alias("_one"))), on or F.lit(True), "left_anti")
    # without groups each part has a row, one of which is null
    return middle.union(rest.groupBy(*groups).agg(F.median("_v").alias("median"))).filter("median is not null")


def latency_summary(samples: DataFrame, value: str, *groups: str) -> DataFrame:
    """(groups, n, mean, median, std) with the population's standard deviation; the median is exact, see medians()."""
    v = F.col(value).cast("double")
    told = samples.groupBy(*groups).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    half = medians(samples, value, *groups)
    on = [told[g].eqNullSafe(half[g]) for g in groups]
    out = told.join(half, on, "left") if groups else told.join(half, F.lit(True), "left")
    return out.select(*[told[g] for g in groups], "n", "mean", "median", "std")
