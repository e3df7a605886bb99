"""Personal data in texts, by weak supervision, in DataFrame and SQL functions only.

Base spans come from fixed patterns with checks.  Around them, wider patterns propose further candidates: addresses with
their signs spelled out, numbers without a plus, what has a base pattern's form but fails its check, keys that a word
announces and long keys that none does, and names behind a title.  Labelers vote on every candidate for or against, or
abstain: its pattern, the check of its digits, its shape, gazetteers of words on either side and of domains, and the
context it stands in.  Expectation-maximisation
over the counts of vote patterns, which are few whatever the corpus, estimates each labeler's reliability without any
labels.  Its posteriors then train the span classifier, a logistic model of the votes, which decides on candidates;
base spans always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark

KINDS = ("email", "ip", "card", "phone", "secret", "name")
# Possessive groups and the anchor \G give the leftmost matches of the plain patterns in linear time: an attempt inside
# a run that has failed at its beginning cannot succeed, unless the last match ended there.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Wider patterns: an address with its signs spelled out, numbers grouped in threes and fours without a plus, and long
# keys after a word that announces them.  Their runs are possessive and have no upper bound, so spans end where runs do.
OPEN_EMAIL = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)++"
OPEN_PHONE = r"(?<![0-9+)(.-])(?<![0-9)]\x20)(?<![+(][0-9]{1,3}[\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
SECRET = r"(?i)(?:api[_-]?key|secret|token|password|passwd)\x20{0,3}[:=]\x20{0,3}[\x22\x27]?[A-Za-z0-9_+/-]{16,}+"
# A key of its own has digits and letters; a name follows a title, or words that announce it.
KEY = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{32,}+"
NAME = r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof)\.?|\b[Nn]ame(?:\x20is|:))\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?+"
#: Code points before and after a candidate that labelers see.
NEAR = 24

SPAN = "struct<kind:int,start:int,stop:int,text:string>"

#: Gazetteers: words that stand by contact data, by other numbers, and last parts of public domains.
FOR_WORDS = ("mail", "call", "phone", "tel", "contact", "mobile", "fax", "card", "visa", "host", "server", "key", "secret", "token", "password")
AGAINST_WORDS = ("version", "isbn", "order", "invoice", "page", "figure", "section", "example of")
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info")
LABELERS = ("pattern", "check", "shape", "gazetteer", "against", "context", "edges")
#: What labelers are believed to do at first, by truth and vote; this belief weighs ten votes.
BELIEF = ({1: 0.2, 0: 0.5, -1: 0.3}, {1: 0.6, 0: 0.1, -1: 0.3})
#: What is known of a check of digits, whose rates are not estimated: no number of failures makes a failure likely.
KNOWN = {"check": ({1: 0.1, 0: 0.7, -1: 0.2}, {1: 0.79, 0: 0.01, -1: 0.2})}
ROUNDS = 25


def _found(text: Column, pattern: str, kind: int) -> Column:
    """array<SPAN>: the leftmost non-overlapping matches; starts and ends in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(held: Column, pair: Column) -> Column:
        start = held["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["m"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), pair["m"].alias("text"))
        return F.struct(stop.alias("at"), F.array_append(held["spans"], span).alias("spans"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, first, step)["spans"]).otherwise(first["spans"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the checksum of a string of digits is right."""
    place = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(place, F.lit(0), add) % 10 == 0


def _base_ok(span: Column) -> Column:
    digits = _digits(span["text"])
    n = F.length(digits)
    ip = span["text"].rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    card = F.when(n.between(13, 19), luhn(digits)).otherwise(False)
    return F.when(span["kind"] == 1, ip).when(span["kind"] == 2, card).when(span["kind"] == 3, n.between(9, 15)).otherwise(True)


def _near_base(span: Column) -> Column:
    """Whether a match that fails its check is a candidate all the same: numbers of a card's or a phone's length."""
    n = F.length(_digits(span["text"]))
    return F.when(span["kind"] == 2, n.between(13, 19)).when(span["kind"] == 3, n >= 7).otherwise(True)


def found(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, base array<SPAN>, open array<SPAN>) of each row: base spans, and candidates that overlap none."""
    df = df.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    t = F.col("_text")
    has = {0: t.contains("@"), 1: t.rlike(r"[0-9]\.[0-9]"), 2: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), 3: t.contains("+")}
    none = F.array().cast(f"array<{SPAN}>")
    for k, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        df = df.withColumn(f"_b{k}", F.when(has[k], _found(t, pattern, k)).otherwise(none))
    opened = {"o0": t.rlike(r"(?i)[\[(]at[\])]"), "o3": t.rlike(r"[0-9][\x20.-][0-9]{4}"), "o4": t.rlike(r"(?i)key|secret|token|passw"), "own": t.rlike(r"[A-Za-z0-9_+/-]{32}"), "name": t.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z]|[Nn]ame(?:\x20is|:)\x20[A-Z]")}
    for name, k, pattern in zip(opened, (0, 3, 4, 4, 5), (OPEN_EMAIL, OPEN_PHONE, SECRET, KEY, NAME)):
        df = df.withColumn(f"_{name}", F.when(opened[name], _found(t, pattern, k)).otherwise(none))
    every = F.concat("_b0", "_b1", "_b2", "_b3")
    df = df.withColumn("base", F.filter(every, _base_ok)).withColumn("_failed", F.filter(every, lambda s: ~_base_ok(s) & _near_base(s)))
    clear = lambda o, others: ~F.exists(others, lambda b: (o["start"] < b["stop"]) & (b["start"] < o["stop"]))
    # what overlaps goes to the base, then to announced and spelled-out spans, then to keys of their own, then to what failed
    df = df.withColumn("_first", F.filter(F.concat("_o0", "_o3", "_o4", "_name"), lambda o: clear(o, "base")))
    df = df.withColumn("_own", F.filter("_own", lambda o: clear(o, "base") & clear(o, "_first")))
    failed = F.filter("_failed", lambda o: clear(o, "base") & clear(o, "_first") & clear(o, "_own"))
    return df.select("_key", "_text", "base", F.concat("_first", "_own", failed).alias("open"))


def _any(text: Column, words) -> Column:
    return text.rlike("(?i)" + "|".join(words))


def votes(span: Column, text: Column) -> list[Column]:
    """A vote of each labeler on a span: 1 for, 0 against, -1 none."""
    kind, own = span["kind"], span["text"]
    n = F.length(_digits(own))
    before = F.substring(text, F.greatest(F.lit(1), span["start"] + 1 - NEAR), F.least(F.lit(NEAR), span["start"]))
    after = F.substring(text, span["stop"] + 1, F.lit(NEAR))
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
    flat = F.length(own) == n
    spelled = own.rlike("@|(?i)dot")
    announced = own.rlike("(?i)^(api[_-]?key|secret|token|passw)")
    fits = F.when(kind == 1, own.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")).when(kind == 2, F.when(n.between(13, 19), luhn(_digits(own))).otherwise(False)).otherwise(n.between(9, 15))
    mixed = (8 * n >= F.length(own)) & (8 * n <= 7 * F.length(own))
    pattern = F.when(kind == 0, F.when(spelled, 1).otherwise(0)).when(kind == 4, F.when(announced, 1).otherwise(-1)).when(kind == 5, 1).when(kind == 3, F.when(own.startswith("+"), 1).otherwise(-1)).otherwise(-1)
    check = F.when((kind == 0) & own.contains("@"), 1).when(kind.isin(1, 2) | ((kind == 3) & own.startswith("+")), vote(fits, F.lit(True))).when((kind == 4) & ~announced, vote(mixed, F.lit(True))).otherwise(-1)
    shape = F.when(kind == 3, vote(n.between(9, 15), F.lit(True))).when(kind == 2, vote(~flat, F.lit(False))).when(kind == 1, vote(~own.rlike(r"(^|\.)0[0-9]"), F.lit(True))).when(kind == 4, vote(own.rlike("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"), F.lit(True))).otherwise(-1)
    ending = own.rlike("(?i)[. ](" + "|".join(DOMAINS) + ")$")
    gazetteer = F.when(kind == 0, vote(ending, F.lit(False))).otherwise(vote(_any(before, FOR_WORDS), F.lit(False)))
    against = vote(F.lit(False), _any(before, AGAINST_WORDS))
    context = vote(before.rlike(r"[:=]\s*$|(?i)\b(at|to|from|on|is)\s+$"), before.rlike(r"[#$€%]\s*$"))
    edges = vote(~before.rlike(r"[0-9A-Za-z]$") & ~after.rlike(r"^[0-9A-Za-z]"), F.lit(True))
    return [pattern, check, shape, gazetteer, against, context, edges]


def em(counts: dict[tuple[int, tuple[int, ...]], int], rounds: int = ROUNDS, names: tuple[str, ...] = ()) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posterior of each (kind, votes) pattern: labelers are independent given the truth, with a prior for each kind.

    rates[l][truth][vote] starts from BELIEF, which keeps the meaning of the classes in place and rare votes in hand;
    labelers of the names in KNOWN keep the rates given there.
    """
    kinds = sorted({k for k, _ in counts})
    prior = {k: 0.7 for k in kinds}
    labelers = range(len(next(iter(counts))[1])) if counts else range(0)
    known = [KNOWN.get(names[i]) if i < len(names) else None for i in labelers]
    rates = [[dict(r) for r in k or BELIEF] for k in known]
    post = {}
    for _ in range(rounds):
        for (k, v), _n in counts.items():
            yes, no = math.log(prior[k]), math.log(1 - prior[k])
            for r, x in zip(rates, v):
                yes, no = yes + math.log(r[1][x]), no + math.log(r[0][x])
            post[k, v] = 1 / (1 + math.exp(max(-500.0, min(500.0, no - yes))))
        for k in kinds:
            total = sum(n for (q, _), n in counts.items() if q == k)
            prior[k] = (7 + sum(n * post[p] for p, n in counts.items() if p[0] == k)) / (10 + total)
        for i, r in enumerate(rates):
            for truth in (0, 1) if known[i] is None else ():
                seen = {x: 10 * start for x, start in BELIEF[truth].items()}
                for p, n in counts.items():
                    seen[p[1][i]] += n * (post[p] if truth else 1 - post[p])
                total = sum(seen.values())
                r[truth] = {x: s / total for x, s in seen.items()}
    return post


def logistic(counts: dict, post: dict, steps: int = 300, rate: float = 0.5) -> list[float]:
    """Weights of the span classifier: bias, then for and against of each labeler; fitted to the posteriors."""
    if not counts:
        return [0.0]
    rows = [([1.0, *(float(x == s) for x in v for s in (1, 0))], post[k, v], n) for (k, v), n in sorted(counts.items())]
    total = sum(n for *_, n in rows)
    w = [0.0] * len(rows[0][0])
    for _ in range(steps):
        grad = [1e-3 * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
            for i, xi in enumerate(x):
                if xi:
                    grad[i] += n / total * (p - y)
        w = [a - rate * g for a, g in zip(w, grad)]
    return w


def spans(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row for each row of df: key, base, added and rejected, all array<struct<kind, start, stop, p>> by kind and start.

    Kinds are indices of KINDS; starts and ends are code points, ends exclusive.  A null text is an empty one, without
    spans; repeated rows get equal spans, null keys are passed on; texts of any length are read whole; no rows give no
    rows; other columns are not looked at.  What is found is not written anywhere: the tables in between hold places
    and votes only, and cut() takes the texts of spans.
    threshold: the classifier's probability from which a candidate is added.
    """
    both = found(df, key, text)
    place = lambda s: [s[c].alias(c) for c in ("kind", "start", "stop")]
    voted = lambda c: F.transform(c, lambda s: F.struct(*place(s), F.array(*votes(s, F.col("_text"))).alias("votes")))
    rows = _spark.written(both.select("_key", voted("base").alias("base"), voted("open").alias("open")))
    # a few hundred patterns of votes at most
    patterns = rows.select(F.explode(F.concat("base", "open")).alias("s")).groupBy("s.kind", "s.votes").count().collect()
    counts = {(r["kind"], tuple(r["votes"])): r["count"] for r in patterns}
    weights = logistic(counts, em(counts, names=LABELERS))

    def scored(s: Column) -> Column:
        z = F.lit(weights[0])
        for i in range(len(LABELERS)):
            v = s["votes"][i]
            z = z + F.when(v == 1, weights[1 + 2 * i]).when(v == 0, weights[2 + 2 * i]).otherwise(0.0) if counts else z
        return F.struct(*place(s), (1 / (1 + F.exp(-z))).alias("p"))

    told = F.array_sort(F.transform("open", scored))
    part = lambda yes: F.filter(told, lambda s: (s["p"] >= threshold) == yes)
    return rows.select(F.col("_key").alias(key), F.array_sort(F.transform("base", scored)).alias("base"), part(True).alias("added"), part(False).alias("rejected"))


def tally(found: DataFrame) -> DataFrame:
    """(kind, base, added, rejected): how many spans of each kind rows of spans() have."""
    each = [found.select(F.explode(c).alias("s")).select(F.get(F.array(*map(F.lit, KINDS)), F.col("s.kind")).alias("kind"), F.lit(c).alias("part")) for c in ("base", "added", "rejected")]
    return each[0].union(each[1]).union(each[2]).groupBy("kind").pivot("part", ["base", "added", "rejected"]).count().na.fill(0)


def cut(text: Column, spans: Column) -> Column:
    """The texts of spans."""
    return F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["stop"] - s["start"]))


def redacted(text: Column, spans: Column) -> Column:
    """text with each span's characters replaced by its kind in brackets; of spans that overlap the earlier one counts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["kind"].alias("kind"))))
    names = F.array(*map(F.lit, KINDS))
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(held: Column, s: Column) -> Column:
        told = F.concat(held["out"], F.substring(text, held["at"] + 1, s["start"] - held["at"]), F.lit("["), F.get(names, s["kind"]), F.lit("]"))
        return F.when(s["start"] >= held["at"], F.struct(told.alias("out"), (-s["back"]).alias("at"))).otherwise(held)

    return F.aggregate(ordered, first, step, lambda h: F.concat(h["out"], F.substring(text, h["at"] + 1, F.length(text))))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op2_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(_spark.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    numbers = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return rows.select("doc_id", *numbers, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size(F.concat("base", "added")).cast("bigint").alias("n_spans"))
