"""Datasets, runs, samples and gold maps on disk, each with a fixed schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs(dataset, doc_id, text), questions, qrels(dataset, qid, doc_id)) of a JSON dataset file."""
    whole = spark.read.schema(S.DATASET).json(path, multiLine=True)
    docs = whole.select(F.col("name").alias("dataset"), F.explode("kb").alias("doc_id", "text"))
    questions = whole.select(F.col("name").alias("dataset"), F.explode("questions").alias("q")).select("dataset", "q.*")
    return docs, questions, questions.select("dataset", "qid", F.explode("gold_docs").alias("doc_id")).distinct()


def write_dataset(name: str, docs: DataFrame, questions: DataFrame, path: str) -> None:
    """A dataset as one JSON object: docs(doc_id, text) become its map kb.  For sets that fit one record."""
    kb = docs.agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "text"))).alias("kb"))
    asked = questions.agg(F.collect_list(F.struct(*questions.columns)).alias("questions"))
    kb.join(asked).select(F.lit(name).alias("name"), "kb", "questions").coalesce(1).write.mode("overwrite").json(path)


def by_qid(questions: DataFrame, order: str) -> DataFrame:
    """One row for each question id: where ids repeat, the last by the column order."""
    others = [c for c in questions.columns if c != "qid"]
    return questions.groupBy("qid").agg(F.max_by(F.struct(*others), order).alias("_q")).select("qid", "_q.*")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, deleted when the session's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and (base.startswith("file:") or "://" not in base):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{base}/files-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def kept(df: DataFrame, rows: int = 0) -> DataFrame:
    """df as a table in the shared folder: what is read several times is computed once, and again only from there.
    rows: the most that a file gets, 0 for any number."""
    path = scratch(df.sparkSession)
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids that are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def picked(docs: DataFrame, asked: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is among asked's, which go to all executors up to a checked number of them: where few
    of many documents are asked for, the texts of the others stay where they are."""
    ids = kept(asked.select(key).distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def write_facts(tables: dict[str, DataFrame], path: str, key: str = "qid", buckets: int | None = None) -> None:
    """Tables bucketed and sorted by key under path, and a manifest of them; what is joined or grouped by key reads them
    without a shuffle.  buckets: the session's number of shuffle partitions, four for each core at most, unless given."""
    import json

    rows = []
    for name, df in tables.items():
        spark = df.sparkSession
        n = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        held = f"budgetlens_{name}_{uuid.uuid4().hex}"
        df.repartition(n, key).write.option("path", f"{path}/{name}").bucketBy(n, key).sortBy(key).format("parquet").saveAsTable(held)
        spark.sql(f"DROP TABLE {held}")  # its files stay
        rows.append((name, key, n, json.dumps(df.schema.jsonValue())))
    spark.createDataFrame(rows, "name string, key string, buckets int, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_facts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of write_facts(), by name, with their buckets.  They stay in the session's catalog until forget()."""
    import json

    from pyspark.sql import types as T

    out = {}
    for r in spark.read.schema("name string, key string, buckets int, schema string").json(f"{path}/manifest").collect():
        held = f"budgetlens_{r['name']}_{uuid.uuid4().hex}"
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(r["schema"])).fields)
        spark.sql(f"CREATE TABLE {held} ({fields}) USING parquet CLUSTERED BY (`{r['key']}`) SORTED BY (`{r['key']}`) INTO {r['buckets']} BUCKETS LOCATION '{path}/{r['name']}'")
        out[r["name"]] = spark.table(held)
        out[r["name"]]._held = held
    return out


def forget(*tables: DataFrame) -> None:
    """Takes tables of read_facts() out of the catalog; their files stay."""
    for df in tables:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._held}")


def write_runs(runs: DataFrame, path: str) -> None:
    """runs([dataset, ]method[, variant], qid, doc_id, rank, score), partitioned by its leading names."""
    names = [c for c in ("dataset", "method", "variant") if c in runs.columns]
    runs.write.mode("overwrite").partitionBy(*names).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_run_file(spark: SparkSession, path: str, method: str) -> DataFrame:
    """runs(method, qid, doc_id, rank) of a JSON run file, whose scores are not kept."""
    rows = spark.read.schema(S.RUN_FILE).json(path, multiLine=True).select(F.explode("results").alias("r"))
    return rows.select(F.lit(method).alias("method"), "r.qid", F.posexplode("r.ranked").alias("p", "doc_id")).select("method", "qid", "doc_id", (F.col("p") + 1).alias("rank"))


def read_all_runs(spark: SparkSession, path: str) -> DataFrame:
    """runs(method, qid, doc_id, rank) of a file that maps each method's questions to lists."""
    whole = spark.read.schema(S.ALL_RUNS).json(path, multiLine=True)
    each = [whole.select(F.lit(m).alias("method"), F.explode(m).alias("qid", "l")) for m in S.ALL_RUNS.names]
    rows = each[0].union(each[1]).union(each[2])
    return rows.select("method", "qid", F.posexplode("l").alias("p", "doc_id")).select("method", "qid", "doc_id", (F.col("p") + 1).alias("rank"))


def ranked_lists(runs: DataFrame, *groups: str) -> DataFrame:
    """(groups, qid, ranked): ids only, in order of rank."""
    lists = runs.groupBy(*groups, "qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("l"))
    return lists.select(*groups, "qid", F.transform("l", lambda x: x["doc_id"]).alias("ranked"))


def preferred(runs: DataFrame, order: tuple[str, ...], *groups: str) -> DataFrame:
    """runs(..., method, variant, ...) with only the first variant in order that a group and method has; others last."""
    place = F.coalesce(*[F.when(F.col("variant") == v, i) for i, v in enumerate(order)], F.lit(len(order)))
    best = runs.groupBy(*groups, "method").agg(F.min(F.struct(place.alias("p"), "variant"))["variant"].alias("variant"))
    return runs.join(best, [*groups, "method", "variant"], "left_semi")


def write_samples(rows: DataFrame, path: str) -> None:
    """rows(split, ...) as JSON lines, a folder for each split."""
    rows.select("split", *S.SAMPLE.names).write.mode("overwrite").partitionBy("split").json(path)


def read_samples(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    from pyspark.sql import types as T

    rows = spark.read.schema(T.StructType([*S.SAMPLE.fields, T.StructField("split", T.StringType())])).json(path)
    return rows.filter(F.col("split") == split) if split else rows


def write_gold(qrels: DataFrame, path: str) -> None:
    """qrels(qid, doc_id) as JSON lines of questions and their documents."""
    qrels.groupBy("qid").agg(F.sort_array(F.collect_set("doc_id")).alias("gold_docs")).write.mode("overwrite").json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("qid string, gold_docs array<string>").json(path).select("qid", F.explode("gold_docs").alias("doc_id"))


def read_gold_map(spark: SparkSession, path: str) -> DataFrame:
    """qrels of a JSON file that is one map from questions to documents."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", S.GOLD)).alias("qid", "g")).select("qid", F.explode("g").alias("doc_id"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, label) of a JSON file that maps questions to labels."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("qid", "label"))


def with_default(value: DataFrame | None, name: str, default: float, spark: SparkSession) -> DataFrame:
    """A one-row table of a cached number, or of its default where the table is missing or empty."""
    if value is None:
        value = spark.createDataFrame([], f"{name} double")
    return value.agg(F.coalesce(F.first(name, ignorenulls=True), F.lit(default)).alias(name))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """vectors(doc_id, vec[, norm]) of a dense index."""
    vectors.write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
