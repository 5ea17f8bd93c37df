"""JSON lines: conversations and run traces. Lines that do not parse are counted, never fatal; blank ones are skipped."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONVERSATION = "conv_id long, turn long, role string, text string, created_at timestamp, metadata map<string,string>"
#: fixed values: keys of trace events whose strings no redactor may touch
KEPT_KEYS = ["type", "run", "kind", "ts", "signal", "from", "to", "mode"]
#: fixed values: further scalar keys of trace events, with their types
TRACE_KEYS = {
    "turn": "int", "attempt": "int", "tool": "string", "verifier": "string", "cost": "int", "success": "boolean", "elapsed_ns": "bigint", "prompt_bytes": "bigint", "output_bytes": "bigint",
    "reason": "string", "signal": "string", "from": "string", "to": "string", "failures": "int", "mode": "string", "step": "string", "confidence": "double", "round": "int", "query": "string", "retrieved": "int",
    "new_sources": "int", "rounds": "int", "sources": "int", "extracted": "int", "added": "int", "updated": "int", "deleted": "int", "archived": "int", "model_calls": "int", "candidates": "int", "agreement": "double",
    "selected": "int", "kind": "string", "category": "string", "message": "string", "label": "string",
}


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """value and file of every line that is not blank."""
    return spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")


def rows(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """Rows of a schema, and _bad: true for lines that are not objects."""
    parsed = lines(spark, *paths).select(F.try_parse_json("value").alias("_v"), F.from_json("value", T._parse_datatype_string(schema)).alias("r"))
    return parsed.select("r.*", (F.col("_v").isNull() | (F.coalesce(F.schema_of_variant("_v"), F.lit("")).startswith("OBJECT") == F.lit(False))).alias("_bad"))


def good(read: DataFrame) -> DataFrame:
    return read.filter(~F.col("_bad")).drop("_bad")


def skipped(read: DataFrame) -> DataFrame:
    """One row: how many lines did not parse."""
    return read.agg(F.count_if("_bad").alias("skipped_lines"))


def append_messages(messages: DataFrame, path: str) -> None:
    messages.write.mode("append").json(path)


def messages(spark: SparkSession, *paths: str) -> DataFrame:
    return good(rows(spark, CONVERSATION, *paths))


def keep_last(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """The last `cap` rows of each key: a bounded store."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


# --- traces


def trace_columns(text: Column) -> list[Column]:
    """type, run, ts and the scalar keys of a trace line. verdict is an object in some events and a string in others:
    both give verdict_type."""
    v = F.try_parse_json(text)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    out = [get("$.type", "string").alias("type"), get("$.run", "string").alias("run"), get("$.ts", "double").alias("ts")]
    out += [get(f"$['{k}']", kind).alias(f"{k}_") if k in ("from", "to") else get(f"$['{k}']", kind).alias(k) for k, kind in TRACE_KEYS.items()]
    kind = F.when(get("$.verdict.type", "string").isNotNull(), get("$.verdict.type", "string")).otherwise(get("$.verdict", "string"))
    return [*out, kind.alias("verdict_type")]


def trace(spark: SparkSession, *paths: str) -> DataFrame:
    """Trace events with their line and _bad; a line without a type, run and time is bad, one of an unknown type is not."""
    read = lines(spark, *paths).select("value", "file", *trace_columns(F.col("value")))
    return read.withColumn("_bad", F.col("type").isNull() | F.col("run").isNull() | F.col("ts").isNull())


def rotated(spark: SparkSession, live: str, keep: int = 4) -> DataFrame:
    """Trace events of a live file and its rotated ones (live.1 the newest), with generation: the oldest is largest."""
    read = trace(spark, f"{live}*")
    number = F.regexp_extract("file", r"\.(\d+)$", 1)
    return read.withColumn("generation", F.when(number == "", 0).otherwise(number.cast("int"))).filter(F.col("generation") <= keep)


def of_run(read: DataFrame, run: str) -> DataFrame:
    return read.filter(F.col("run") == run)


def write_trace(events: DataFrame, path: str, rows_a_file: int = 100_000) -> None:
    """Events (type, run, ts and any other columns) as JSON lines without null keys; files end at `rows_a_file`."""
    events.write.mode("append").option("maxRecordsPerFile", rows_a_file).option("ignoreNullFields", True).json(path)


def redact_trace(text: Column, rules) -> Column:
    """A trace line with every string redacted at any depth but those of the kept keys; numbers, booleans and nulls stay
    what they are. Inside `payload` keys are redacted too and none is kept. A line that does not parse says so instead."""
    compiled = [(re.compile(pattern), put) for _, pattern, put in rules]

    def clean(value: str) -> str:
        for pattern, put in compiled:
            value = pattern.sub(lambda _, put=put: put, value)
        return value

    def scrub(value, free: bool):
        if isinstance(value, str):
            return clean(value)
        if isinstance(value, list):
            return [scrub(v, free) for v in value]
        if isinstance(value, dict):
            return {clean(k) if free else k: v if not free and k in KEPT_KEYS else scrub(v, free or k == "payload") for k, v in value.items()}
        return value

    def line(value: str | None) -> str | None:
        try:
            read = json.loads(value)
            if isinstance(read, dict):
                return json.dumps(scrub(read, False), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, TypeError, RecursionError):
            pass
        return '{"type":"trace.redaction_failed"}'

    @F.pandas_udf("string")
    def redacted(values: pd.Series) -> pd.Series:
        return values.map(line)

    return redacted(text)


def masked_columns(events: DataFrame, level: str, private: tuple[str, ...] = ("message", "reason", "query")) -> DataFrame:
    """What a log shows: all (maximal), private texts hidden (balanced), or only types and times (opaque)."""
    if level == "maximal":
        return events
    if level == "opaque":
        return events.select("type", "run", "ts")
    return events.withColumns({c: F.when(F.col(c).isNotNull(), F.lit("<private>")) for c in private if c in events.columns})
