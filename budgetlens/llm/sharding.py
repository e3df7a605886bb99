"""Rendezvous (highest random weight) hashing of stable keys over weighted shards.

Each (key, shard) pair gets a pseudo-random number u in (0, 1); a key goes to the shard with the largest
``-weight / ln(u)``.  A shard that is added only draws the keys for which it wins, and one that is taken away only
gives up its own.  All of it is SQL arithmetic: one md5 a row, then a polynomial modulo a prime for each shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark

PRIME = 2147483647
#: Rows that one slot bucket of one shard holds on average.
BUCKET_ROWS = 50_000


def _part(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def _constants(shard: int) -> tuple[int, int]:
    a = (48271 * (shard + 1) * (shard + 11) * 69621 + 16807) % PRIME
    return a, (a * 1103515245 + 12345 * (shard + 7)) % PRIME


def _draw(h1: Column, h2: Column, h3: Column, shard: int) -> Column:
    """A number in [0, PRIME): two polynomial rounds, below 2**63 throughout."""
    a, b = _constants(shard)
    v = (h1 * F.lit(a).cast("bigint") + h2) % PRIME
    w = (v * v + h3) % PRIME
    return (w * F.lit(b).cast("bigint") + h2) % PRIME


def _best(columns: tuple[Column, Column, Column], weights: list[float]) -> Column:
    """Index of the shard with the largest score; the lowest index wins a tie."""
    scored = [F.struct((F.lit(-float(w)) / F.log((_draw(*columns, j) + 1) / F.lit(float(PRIME + 1)))).alias("s"), F.lit(-j).alias("j")) for j, w in enumerate(weights)]
    return (-F.array_max(F.array(*scored))["j"]).cast("int")


def assign(df: DataFrame, key: str, weights: list[float]) -> DataFrame:
    """df with ``shard`` (and ``_h4``, an independent hash): see shards().  A null key counts as the text ''.

    weights: a positive weight for each shard.
    """
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    hashed = df.withColumn("_digest", digest).select(*df.columns, *[(_part(F.col("_digest"), k) % PRIME).alias(f"_h{k + 1}") for k in range(4)])
    return hashed.withColumn("shard", _best((F.col("_h1"), F.col("_h2"), F.col("_h3")), weights))


def shards(df: DataFrame, key: str, text: str, weights: list[float], grown_weights: list[float] | None = None, buckets: int | None = None) -> DataFrame:
    """A row for each row of df: key, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 8.  slot numbers the rows of a shard from 0 without gaps: rows
    lie in hash buckets (their number follows the row count, unless given), the buckets' counts are summed up, and
    rows are ordered only within a bucket, so no task ever holds a shard.  Repeated rows get slots of their own in an
    order that does not matter; a null key is a key like any other; no rows give no rows.
    grown_weights: weights with a shard more, for grown_shard.
    """
    spark = df.sparkSession
    if buckets is None:
        buckets = max(1, -(-df.count() // (BUCKET_ROWS * len(weights))))
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    slim = df.select(F.col(key).alias("_key"), (F.octet_length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = assign(slim, "_key", weights).withColumn("_bucket", F.col("_h4") % buckets)
    grown = _best((F.col("_h1"), F.col("_h2"), F.col("_h3")), grown_weights) if grown_weights else F.lit(None).cast("int")
    placed = placed.withColumn("grown_shard", grown)
    # the counts need only the key column
    counts = assign(df.select(F.col(key).alias("_key")), "_key", weights).groupBy("shard", (F.col("_h4") % buckets).alias("_bucket")).agg(F.count("*").alias("_n"))
    sums = "sum(_n) OVER (PARTITION BY shard ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - _n AS _before"
    before = counts.selectExpr("shard AS _s", "_bucket AS _b", sums)
    numbered = placed.selectExpr("*", "row_number() OVER (PARTITION BY shard, _bucket ORDER BY _key, text_crc32, size) - 1 AS _in")
    joined = numbered.join(before, (F.col("shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_in")).cast("bigint").alias("slot"), "grown_shard")


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(_spark.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", [1.0] * 24, [1.0] * 25)


def op9_sql(n: int = 24) -> str:
    """The query in DuckDB's SQL, with the CRC of polynomial 3988292384 spelled out."""

    def best(shards: int) -> str:
        scores = []
        for j in range(shards):
            a, b = _constants(j)
            v = f"((h1 * {a}::BIGINT + h2) % {PRIME})"
            scores.append(f"{{'s': -1.0::DOUBLE / ln(((({v} * {v} + h3) % {PRIME} * {b}::BIGINT + h2) % {PRIME} + 1)::DOUBLE / {float(PRIME + 1)}::DOUBLE), 'j': {-j}}}")
        return f"-list_max([{', '.join(scores)}]).j"

    parts = ", ".join(f"CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), {8 * k + 1}, 8) AS BIGINT) % {PRIME} AS h{k + 1}" for k in range(4))
    return f"""
WITH hashed AS (SELECT doc_id, coalesce(encode(text), ''::BLOB) AS raw, {parts} FROM documents),
placed AS (SELECT doc_id, raw, {best(n)} AS shard, {best(n + 1)} AS grown_shard, h4 % (SELECT greatest(1, -(-count(*) // {BUCKET_ROWS * n}))::BIGINT FROM documents) AS bucket FROM hashed),
powers AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS p),
crcs AS (
  SELECT raw, xor(list_reduce(list_transform(regexp_extract_all(hex(raw), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c // 256, p[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM (SELECT DISTINCT raw FROM placed), powers)
SELECT doc_id, octet_length(raw) + 8 AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32) - 1 AS slot, grown_shard
FROM placed JOIN crcs USING (raw)"""
