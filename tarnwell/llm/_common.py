"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS = ("documents", "pages")
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it lies; texts of fewer files than cores, of which a file of one row group would be one task's work,
    are dealt out by id first."""
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return read.repartition(cores, read.columns[0]) if name in TEXTS and len(read.inputFiles()) < cores else read


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one given to setCheckpointDir. Without
    either a local master gets a temporary one; a cluster's executors would not see it, so there it is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="tarnwell-")
        shared_dir.own = base
    return base.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise has written and no plan reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df.__dict__["_written"]
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def laid_out(df: DataFrame, key: str, label: str, parts: int | None = None) -> DataFrame:
    """As materialise, in `parts` buckets of key, each sorted by it; if there are as many as a shuffle has partitions, which
    is the default, joins and groups by key read it without another shuffle."""
    spark = df.sparkSession
    parts, name = parts or int(spark.conf.get("spark.sql.shuffle.partitions")), f"spark_catalog.default.tarnwell_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.repartition(parts, key).write.format("parquet").option("path", path).bucketBy(parts, key).sortBy(key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # its files stay where they are, and the plan knows them
    out.__dict__["_written"] = path
    return out


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def binary(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: int | str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose column holds about `most` bytes, so that what is made of a piece stays small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for s, e in chunks([n + 64 for n in sizes], most):
        yield batch.slice(s, e - s)


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to about `most`; a larger item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
