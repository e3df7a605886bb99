"""URL filtering by a character language-model ratio.

Two variable-order Markov models, one of accepted and one of rejected URLs, give each character a probability from the
longest context seen, interpolated with all shorter ones (Witten-Bell).  A URL is judged by the difference of its
log-likelihoods per character against a calibrated threshold.  Rules on host and path go before the models.

Labels are the caller's, or weak ones: a host with a word of unwanted trades is rejected, others are accepted, and what
a rule blocks is not learnt from.  The models must not learn hosts by heart, or they would repeat the labels: a gram
counts once for each host that has it, a URL is scored by counts to which no URL of its own fold of hosts has added, the
host's last label (com, net) is left out, and under weak labels, which are a host's, all URLs of a host are judged by
their common mean.  The threshold lies halfway between the middle of the rejected and that of the accepted, so unwanted
hosts whose words no list names are told by their letters alone.

The counts cover every labelled URL and are exact: ORDER + 1 symbols fit a 64-bit number, so nothing is hashed.  They
are a table that grows with the distinct grams.  A gram has one ratio wherever it stands, so the distinct grams of the
URLs are joined with the counts, order by order, and their ratios go back to groups of URLs, once for each group.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _links, _spark, _text

ORDER = 5
#: Folds of hosts, each scored by the counts of the others.
FOLDS = 5
ALPHABET = 258
#: Bits of a symbol; a gram of ORDER + 1 has the predicted one lowest.
BITS = 9
#: Bytes of URLs whose grams are combined before they are joined.
GROUP_BYTES = 1 << 20

#: The rules of the contract: (what to do, host + path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Whole words of a host that label its URLs as unwanted; they do not judge.
SEED_WORDS = ("casino", "bets", "poker", "ads", "track", "porn", "xxx", "viagra")


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` with A-Z lowered, path up to ``?`` or ``#``; both empty without."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return _spark.ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def ruled(host: Column, path: Column, rules) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    chain = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def _layout(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all URLs, each after ORDER pads (0) and before an end mark (1); what is predicted; first of each URL."""
    n = np.diff(off)
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n + ORDER + 1, out=first[1:])
    sym = np.zeros(first[-1], np.uint64)
    at = np.arange(len(buf)) + np.repeat(first[:-1] + ORDER - off[:-1], n)
    sym[at] = buf.astype(np.uint64) + np.uint64(2)
    sym[first[1:] - 1] = 1
    return sym, np.flatnonzero(sym), first


def _grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each predicted symbol, and how many each URL has (its bytes and the end mark)."""
    sym, at, _ = _layout(buf, off)
    gram = np.zeros(len(at), np.uint64)
    for k in range(ORDER + 1):
        gram |= sym[at - k] << np.uint64(BITS * k)
    return gram.astype(np.int64), np.diff(off) + 1


def _suffix(gram: str, k: int) -> Column:
    """The last k + 1 symbols of a gram: the context of order k and what it predicts."""
    return F.col(gram).bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1))


class Model:
    """Counts of all grams of the labelled URLs: counts(gram, n0_f, n1_f), by class and for each fold without its own
    hosts; the last fold has all of them."""

    def __init__(self, counts: DataFrame, folds: int = 0) -> None:
        self.counts, self.folds = counts, folds

    def ratios(self, grams: DataFrame) -> DataFrame:
        """(gram, ratio array): for each fold log P(accepted) - log P(rejected) of what each of grams(gram) predicts."""
        every = [f"{c}_{f}" for c in (0, 1) for f in range(self.folds + 1)]
        sums = lambda rows, gram: rows.groupBy(gram.alias("gram")).agg(*[F.sum(f"n{e}").alias(f"n{e}") for e in every], F.max("asked").alias("asked"))
        asked = grams.select("gram", *[F.lit(0).cast("bigint").alias(f"n{e}") for e in every], F.lit(True).alias("asked"))
        both = _spark.written(sums(self.counts.withColumn("asked", F.lit(False)).union(asked), F.col("gram")))
        shorter = None
        for k in range(ORDER + 1):
            rows = sums(both, _suffix("gram", k))
            # a context is followed by at most ALPHABET distinct symbols, so no window is large
            after = Window.partitionBy(F.shiftright("gram", BITS))
            rows = rows.select("*", *[F.sum(f"n{e}").over(after).alias(f"all{e}") for e in every], *[F.count_if(F.col(f"n{e}") > 0).over(after).alias(f"kinds{e}") for e in every]).filter("asked")
            if shorter is None:
                rows = rows.select("*", *[F.lit(1.0 / ALPHABET).alias(f"p{e}") for e in every])
            else:
                rows = rows.withColumn("tail", _suffix("gram", k - 1)).join(shorter, "tail")
            told = lambda e: F.when(F.col(f"all{e}") > 0, (F.col(f"n{e}") + F.col(f"kinds{e}") * F.col(f"p{e}")) / (F.col(f"all{e}") + F.col(f"kinds{e}"))).otherwise(F.col(f"p{e}"))
            shorter = rows.select(F.col("gram").alias("tail"), *[told(e).alias(f"p{e}") for e in every])
        ratio = F.array(*[F.log(f"p1_{f}") - F.log(f"p0_{f}") for f in range(self.folds + 1)])
        return shorter.select(F.col("tail").alias("gram"), ratio.alias("ratio"))


def _mean_ratio(buf: np.ndarray, off: np.ndarray, known: np.ndarray, ratio: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Mean ratio of each URL's symbols in its fold; known holds all grams, in any order, ratio a row for each."""
    gram, length = _grams(buf, off)
    if not len(length):
        return np.zeros(0)
    order = np.argsort(known)
    each = ratio[order[np.searchsorted(known[order], gram)], np.repeat(fold, length)]
    return np.add.reduceat(each, np.cumsum(length) - length) / length


def _log_ratio(model: Model, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """log P(accepted) - log P(rejected) per symbol of each of a few URLs, by all counts."""
    grams = model.counts.sparkSession.createDataFrame([(g,) for g in np.unique(_grams(buf, off)[0]).tolist()], "gram bigint")
    found = model.ratios(grams).select("gram", F.element_at("ratio", -1).alias("ratio")).toArrow()
    return _mean_ratio(buf, off, found["gram"].to_numpy(), found["ratio"].to_numpy()[:, None], np.zeros(len(off) - 1, np.int64))


def _counted(batches):
    """(gram, n0, n1) of batches of (url, label), combined by slice."""
    for batch in batches:
        buf, off = _text.strings(batch.column(0))
        labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in _text.slices(off):
            gram, length = _grams(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            key, n = np.unique(gram | np.repeat(labels[a:b], length) << np.int64(BITS * (ORDER + 1)), return_counts=True)
            cls = key >> np.int64(BITS * (ORDER + 1))
            columns = [key & np.int64((1 << BITS * (ORDER + 1)) - 1), n * (cls == 0), n * (cls == 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["gram", "n0", "n1"])


def _once(batches):
    """(gram, label, unit, fold) of batches of (url, label, unit, fold), equal ones of a slice once."""
    for batch in batches:
        buf, off = _text.strings(batch.column(0))
        labels, unit, fold = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
        for a, b in _text.slices(off):
            gram, length = _grams(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            rows = [gram, *(np.repeat(c[a:b], length) for c in (labels, unit, fold))]
            order = np.lexsort(rows[::-1])
            rows = [c[order] for c in rows]
            new = np.ones(len(order), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in rows], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(c[new]) for c in rows], ["gram", "label", "unit", "fold"])


def train(labelled: DataFrame, folds: int = 0) -> Model:
    """The two models from labelled(url, label): label 1 accepted, 0 rejected.  All rows count.

    folds: labelled has a ``unit`` (a number, such as a host's hash) and a ``fold`` under ``folds`` too; then a gram
    counts once for each unit and label, and the model has counts without each fold.
    """
    _spark.small_batches(labelled.sparkSession, 10_000)
    url, label = F.col("url"), F.col("label").cast("bigint")
    if not folds:
        rows = _spark.mapped(labelled.select(url, label), _counted, "gram bigint, n0 bigint, n1 bigint")
        return Model(_spark.written(rows.groupBy("gram").agg(F.sum("n0").alias("n0_0"), F.sum("n1").alias("n1_0"))))
    rows = _spark.mapped(labelled.select(url, label, F.col("unit").cast("bigint"), F.col("fold").cast("bigint")), _once, "gram bigint, label bigint, unit bigint, fold bigint").distinct()
    of = lambda c, f: F.count_if((F.col("label") == c) & (F.col("fold") != f)).alias(f"n{c}_{f}")
    return Model(_spark.written(rows.groupBy("gram").agg(*[of(c, f) for c in (0, 1) for f in range(folds + 1)])), folds)


def _grouped(batches):
    """Batches whose first column is the URL, with a group for each row; a group holds GROUP_BYTES or a single URL."""
    group, held = uuid.uuid4().hex, 0
    for batch in batches:
        _, off = _text.strings(batch.column(0))
        for a, b in _text.slices(off, GROUP_BYTES // 4):
            size = int(off[b] - off[a]) + b - a
            if held and held + size > GROUP_BYTES:
                group, held = uuid.uuid4().hex, 0
            held += size
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([group] * (b - a))], [*part.schema.names, "_group"])


def _group_grams(batches):
    """(group, gram) of batches of (url, group), equal ones of a task once."""
    last, seen = None, np.zeros(0, np.int64)
    for batch in batches:
        buf, off = _text.strings(batch.column(0))
        groups = np.array(batch.column(1).to_pylist(), dtype=object)
        first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, np.int64)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(groups)]):
            gram = np.unique(_grams(buf[off[a] : off[b]], off[a : b + 1] - off[a])[0])
            if groups[a] != last:
                last, seen = groups[a], np.zeros(0, np.int64)
            fresh = np.setdiff1d(gram, seen, assume_unique=True)
            seen = np.union1d(seen, fresh)
            yield pa.RecordBatch.from_arrays([pa.array([last] * len(fresh), pa.string()), pa.array(fresh)], ["_group", "gram"])


def scores(df: DataFrame, url: str, model: Model, name: str = "lm_score", fold: str | None = None) -> DataFrame:
    """df with the log-likelihood difference per character; a null URL counts as an empty one.

    fold: a column with the fold whose URLs the counts must not have seen; without it all counts are used.
    """
    spark = df.sparkSession
    _spark.small_batches(spark, 10_000)
    own = F.col(fold).cast("int") if fold else F.lit(model.folds)
    slim = df.select(url, own.alias("_fold"), *[c for c in df.columns if c != url])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    rows = _spark.written(_spark.mapped(slim, _grouped, f"{fields}, _group string"))
    grams = _spark.written(_spark.mapped(rows.select(url, "_group"), _group_grams, "_group string, gram bigint"))
    ratios = model.ratios(grams.select("gram"))
    told = grams.join(ratios, "gram").groupBy("_group").agg(F.collect_list(F.struct("gram", "ratio")).alias("l")).select("_group", F.col("l.gram").alias("grams"), F.flatten("l.ratio").alias("ratios"))

    def work(key, left, right):
        buf, off = _text.strings(left.column(0))
        known, ratio = (right.column(c).combine_chunks().flatten().to_numpy() for c in ("grams", "ratios"))
        out = _mean_ratio(buf, off, known, ratio.reshape(len(known), -1), left.column(1).to_numpy().astype(np.int64))
        return left.drop_columns(["_group", "_fold"]).append_column(name, pa.array(out))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "_fold")
    return rows.groupBy("_group").cogroup(told.groupBy("_group")).applyInArrow(work, f"{kept}, `{name}` double")


def threshold(scored: DataFrame) -> float:
    """Halfway between the middle scores of scored(lm_score, label)'s two labels; minus infinity without both.

    The middle is the mean of the rejected and the median of the accepted: unwanted ones among these move it little.
    """
    of = lambda c, f: f(F.when(F.col("label") == c, F.col("lm_score")))
    low, high = scored.agg(of(0, F.avg), of(1, lambda x: F.percentile_approx(x, 0.5, 10_000))).first()
    return -math.inf if low is None or high is None else (low + high) / 2


def modelled(host: Column, path: Column) -> Column:
    """What the models read of a URL: its host without the last label, and its path."""
    return F.concat(F.regexp_replace(host, r"\.[^.]*$", ""), path)


def weak_labels(host: Column, verdict: Column, seed_words=SEED_WORDS) -> Column:
    """0 for hosts with a seed word between signs or digits, 1 for others, null without a host and where a rule blocks."""
    seed = host.rlike("(^|[^a-z])(" + "|".join(seed_words) + ")([^a-z]|$)") if seed_words else F.lit(False)
    return F.when((host == "") | F.coalesce(verdict == "block", F.lit(False)), None).when(seed, 0).otherwise(1).cast("int")


def judge(df: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, label: str | None = None, seed_words=SEED_WORDS, folds: int = FOLDS) -> DataFrame:
    """A row for each row of df: key, host, path, rule, verdict, lm_score.

    rule is the longest rule that fits (null: none), and verdict its word; without a rule the models decide.  A null
    URL, or one without ``://``, has an empty host and path, which is what the models see.  A score equal to the
    threshold is accepted; without labelled URLs of both kinds all are.  Repeated rows are judged alike,
    null keys are passed on, and columns other than these are not looked at, whatever they are called.
    label: a column of df with 1 for accepted, 0 for rejected and null for unknown URLs, each judged by its own score;
    without it weak_labels(), and lm_score is the mean per character of all URLs of the host.
    folds: hosts are dealt to so many folds by a hash; URLs are scored, and the threshold is set, by counts without
    their own fold.
    """
    base = df.select(F.col(key).alias("_key"), F.col(url).alias("_url"), (F.col(label).cast("int") if label else F.lit(None).cast("int")).alias("_label"))
    host, path = parsed(F.col("_url"))
    base = base.withColumn("host", host).withColumn("path", path)
    base = base.withColumn("_rule", ruled(F.col("host"), F.col("path"), rules)).withColumn("url", modelled(F.col("host"), F.col("path")))
    told = F.col("_label") if label else weak_labels(F.col("host"), F.col("_rule.verdict"), seed_words)
    unit = F.xxhash64("host")
    base = base.withColumn("label", F.when(F.col("_url").isNotNull(), told)).withColumn("unit", unit).withColumn("fold", F.pmod(F.xxhash64(unit), F.lit(folds)).cast("int"))
    model = train(base.filter("label is not null"), folds)
    out = _spark.written(scores(base, "url", model, fold="fold"))
    if label:
        limit = threshold(out.filter("label is not null"))
    else:
        size = F.octet_length("url") + 1
        hosts = _spark.written(out.groupBy("host").agg((F.sum(F.col("lm_score") * size) / F.sum(size)).alias("_mean"), F.max("label").alias("label")))
        limit = threshold(hosts.select(F.col("_mean").alias("lm_score"), "label"))
        few = hosts.count() <= _links.BROADCAST_IDS
        means = hosts.select("host", "_mean")
        out = out.join(F.broadcast(means) if few else means, "host").withColumn("lm_score", F.col("_mean"))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("lm_score") >= limit, "allow").otherwise("block"))
    return out.select(F.col("_key").alias(key), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "lm_score")


def op6_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_spark.table(spark, sf_dir, "pages").select("page_id", "url"))
