"""python -m budgetlens: runs a retrieval phase, or any registered query, on a folder of tables.

    python -m budgetlens retrieve --phase rerank --tables DIR --k 20 --out RUNS
    python -m budgetlens query --name recall_matrix --tables DIR [--out FOLDER]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.fixtures import fixtures
from .plans.queries import PHASES, QUERIES, retrieve
from .sources import files


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="budgetlens")
    commands = parser.add_subparsers(dest="command", required=True)
    search = commands.add_parser("retrieve", help="ranked lists of one phase, written as runs")
    search.add_argument("--phase", choices=sorted(PHASES), required=True)
    search.add_argument("--k", type=int, default=20)
    search.add_argument("--out", required=True)
    one = commands.add_parser("query", help="a registered query, shown or written as Parquet")
    one.add_argument("--name", choices=sorted(QUERIES), required=True)
    one.add_argument("--out")
    for c in (search, one):
        c.add_argument("--tables", required=True)
    told = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("budgetlens").getOrCreate()
    if told.command == "retrieve":
        files.write_runs(retrieve(fixtures(spark, told.tables), told.phase, told.k).select(F.lit(told.phase).alias("method"), "qid", "doc_id", "rank", "score"), told.out)
    elif told.out:
        QUERIES[told.name](spark, told.tables).write.mode("overwrite").parquet(told.out)
    else:
        QUERIES[told.name](spark, told.tables).show(100, truncate=False)


if __name__ == "__main__":
    main()
