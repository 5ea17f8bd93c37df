"""Versioned snapshots of tables: a new folder for each version, complete once Spark has put its mark there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, from the file system that the path belongs to."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n[8:]) for n in names if n.startswith("version_") and n[8:].isdigit() and done(n))


def save(df: DataFrame, path: str) -> int:
    """Write the next version whole; readers see the one before until it is complete."""
    number = max(_versions(df.sparkSession, path), default=0) + 1
    df.withColumn("_schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").parquet(f"{path}/version_{number}")
    return number


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last complete version; no version is an empty table; another schema version is an error."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    read = spark.read.parquet(f"{path}/version_{versions[-1]}")
    right = F.when(F.col("_schema_version") != SCHEMA_VERSION, F.raise_error(F.lit("unsupported snapshot version"))).otherwise(F.lit(True))
    return read.filter(right).drop("_schema_version")


def report_lines(report: DataFrame) -> DataFrame:
    """One JSON text a row, keys sorted."""
    return report.select(F.to_json(F.struct(*sorted(report.columns)), {"ignoreNullFields": "false"}).alias("value"))


def for_baseline(report: DataFrame, times: tuple[str, ...] = ("started_at", "ended_at"), counts: tuple[str, ...] = ("elapsed_ns",), ids: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """The report with what differs from run to run made constant."""
    put = {c: F.lit("1970-01-01 00:00:00").cast(report.schema[c].dataType) for c in times if c in report.columns}
    put |= {c: F.lit(0).cast(report.schema[c].dataType) for c in counts if c in report.columns}
    put |= {c: F.lit("").cast(report.schema[c].dataType) for c in ids if c in report.columns}
    return report.withColumns(put) if put else report


def fixed(spark: SparkSession, rows: list[tuple], schema: str, limit: int | None = None) -> DataFrame:
    """A retriever's fixed rows; no rows give an empty result with the schema."""
    return spark.createDataFrame(rows if limit is None else rows[:limit], schema)
