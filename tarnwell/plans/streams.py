"""Queries that run as streams over the events until no data is left, then give their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.plans._registry import registry
from tarnwell.sources.cuts import new_folder
from tarnwell.streaming import metrics, stateful

QUERIES, query = registry()


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The table that a stream has written when its sources are exhausted. Both modes write Parquet from the executors;
    in complete mode each batch writes the whole result and the last batch's counts."""
    spark, at = stream.sparkSession, new_folder(stream.sparkSession, "stream")
    start = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state")
    if mode == "complete":
        batches: list[int] = []

        def keep(result: DataFrame, number: int) -> None:
            result.write.mode("overwrite").parquet(f"{at}/rows/{number}")
            batches.append(number)

        start.foreachBatch(keep).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/rows/{max(batches)}") if batches else spark.createDataFrame([], stream.schema)
    start.format("parquet").option("path", f"{at}/rows").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as events, round(sum(value), 4) as total from events group by all")
def stream_hourly(s, d):
    got = drained(metrics.windowed(metrics.timed(_stream(s, d)), ["event_type"]), "complete")
    return got.select(F.col("started").cast("timestamp_ntz").alias("hour"), "event_type", "events", F.round("total", 4).alias("total"))


@query(
    """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 30 minute then 1 else 0 end as new from events),
n as (select *, sum(new) over (partition by user_id order by ts, event_id) as s from g)
select user_id, min(ts) as started, count(*) as events from n group by user_id, s"""
)
def stream_sessions(s, d):
    got = drained(metrics.sessions(metrics.timed(_stream(s, d)), "user_id"), "complete")
    return got.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "events")


@query()
def stream_breakers(s, d):
    """The breakers' batch form is breaker_states; both share one state machine."""
    e = _stream(s, d).withColumn("bad", F.col("event_type") == "error")
    return drained(stateful.breakers(e, "user_id", "ts", "event_id", "bad", 2, 3600.0))


@query()
def stream_memory(s, d):
    """Each user's last claims, with what became of every claim."""
    c = _stream(s, d).select(F.col("user_id").alias("thread_id"), F.col("event_type").alias("slot"), F.concat_ws(" ", F.col("value").cast("int").cast("string"), "props").alias("text"), F.col("ts").alias("valid_from"), (F.col("event_id") % 11 == 0).alias("retraction"))
    return drained(stateful.thread_memory(c))
