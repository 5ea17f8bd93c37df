"""Registering queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: bytes of a file's table that a task gets where the rows are dealt out
PIECE = 32 << 20


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose rows cost much to look at. A file of one row group is read by one task, so where there are fewer
    files than cores the rows are dealt out first, to more tasks the more there are; tables of more files are read as they lie."""
    read, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    if len(read.inputFiles()) >= cores:
        return read
    size = int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return read.repartition(max(cores, -(-size // PIECE)), read.columns[0])


def registry() -> tuple[dict, Callable]:
    queries: dict = {}

    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = (f, sql)
            return f

        return put

    return queries, query


def toks(x: str) -> str:
    """SQL of a text's tokens."""
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda t: t <> '')"
