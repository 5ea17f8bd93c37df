"""Run traces: rollups, latency percentiles, budgets, breakers, routing, key-value logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.streaming.stateful import advance


def rollup(events: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """Counts and sums by the given columns and all their prefixes; exact on the whole."""
    return events.rollup(*by).agg(F.count("*").alias("events"), F.round(F.sum(value), 4).alias("total"), F.grouping_id().cast("long").alias("level"))


def latency_stats(events: DataFrame, by: str, value: str, percentiles=(0.5, 0.95, 0.99), exact: bool = True) -> DataFrame:
    """count, total, min, max, mean and percentiles, each the element at int((n - 1) * p) of the sorted values.

    Places are found by row numbers, so no group's values are gathered; exact=False uses a sketch."""
    base = events.groupBy(by).agg(F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean"))
    names = [f"p{int(p * 100)}" for p in percentiles]
    if not exact:
        return base.join(events.groupBy(by).agg(*[F.approx_percentile(value, p, 10000).alias(n) for p, n in zip(percentiles, names)]), by)
    # counts of distinct values first: a hot group shrinks to its values before any of it is sorted
    counts = events.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    run = counts.withColumn("upto", F.sum("c").over(W.partitionBy(by).orderBy(value))).join(base.select(by, "n"), by)
    picks = [F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * F.lit(p)), F.col(value))).alias(n) for p, n in zip(percentiles, names)]
    return base.join(run.groupBy(by).agg(*picks), by)


def budget_use(events: DataFrame, run: str, order: list[str], cost: str, limit: float) -> DataFrame:
    """Adds used (so far) and crossed: true on the one event at which the limit is first passed."""
    w = W.partitionBy(run).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = events.withColumn("used", F.sum(cost).over(w))
    # the sums as they are are held against the limit; rounded ones would be at it where these are just above
    return summed.withColumn("crossed", (F.col("used") > limit) & (F.col("used") - F.col(cost) <= limit)).withColumn("used", F.round("used", 4))


def exhausted(usage: dict[str, Column], limits: dict[str, float], adding: str | None = None) -> Column:
    """Name of the first budget, in the usage's order, with nothing left; with `adding`, of the first that one more of
    that counter would break. Clocks and tokens are used up at their limit."""
    out = F.lit(None).cast("string")
    for name, used in reversed(usage.items()):
        over = used >= limits[name] if adding is None or name in ("wallClock", "outputTokens") else used + int(name == adding) > limits[name]
        out = F.when(over, F.lit(name)).otherwise(out)
    return out


def latest(log: DataFrame, keys: list[str], order: list[str], op: str = "op") -> DataFrame:
    """Live rows of a set/delete log: the last operation of each key, deleted keys left out."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").filter(F.col(op) != "delete")


def breakers(events: DataFrame, signal: str, at: str, event_id: str, failed: str, threshold: int = 3, cooldown: float = 30.0) -> DataFrame:
    """signal, event_id, state after each event: consecutive failures open a breaker; after the cool-down it is half
    open, where a success closes it and a failure opens it anew. One signal's events are one ordered state machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, ("closed", 0, 0.0)
        for batch in batches:
            names, ids, times, bads = (batch.column(i).to_pylist() for i in range(4))
            modes = []
            for name, t, bad in zip(names, times, bads):
                state = advance(state if name == now else ("closed", 0, 0.0), t, bad, threshold, cooldown)
                now = name
                modes.append(state[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(modes, pa.string())], names=["signal", "event_id", "state"])

    rows = events.select(F.col(signal).cast("string").alias("signal"), F.col(event_id).cast("long").alias("id"), (F.unix_micros(F.col(at).cast("timestamp")) / F.lit(1e6)).alias("at"), F.col(failed).cast("boolean").alias("bad"))
    # sorted rows pass by with one state: no signal's events are held together
    return rows.repartition("signal").sortWithinPartitions("signal", "at", "id").mapInArrow(run, "signal string, event_id long, state string")


def sessions(events: DataFrame, key: str, at: str, order: str, gap_seconds: float) -> DataFrame:
    """key, session, started, ended, events: a gap of at least `gap_seconds` begins a new session."""
    w = W.partitionBy(key).orderBy(at, order)
    apart = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) / F.lit(1e6)
    marked = events.withColumn("_new", F.coalesce((apart >= gap_seconds).cast("int"), F.lit(0))).withColumn("session", F.sum("_new").over(w))
    return marked.groupBy(key, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("events"))


def routed(attempts: DataFrame, run: str, step: str, confidence: str, least: float) -> DataFrame:
    """The first attempt of each run that is confident enough, else its last one."""
    good = (F.col(confidence) >= least).cast("int")
    w = W.partitionBy(run).orderBy(F.desc(good), F.when(good == 1, F.col(step)).asc_nulls_last(), F.desc(step))
    return attempts.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def tool_outcome(requested: Column, allowed: Column, arguments: Column, output: Column) -> Column:
    """What became of a tool call: each gate in order."""
    return F.when(~requested, "overBudget").when(~allowed, "denied").when(arguments != "pass", "argumentRejected").when(output != "pass", "outputRejected").otherwise("completed")


def backoff(attempt: Column, initial: float = 0.5, factor: float = 2.0, most: float = 30.0) -> Column:
    return F.least(F.lit(initial) * F.pow(F.lit(factor), attempt - 1), F.lit(most))


def trace_metrics(trace: DataFrame, key: str) -> DataFrame:
    """Counts by tool or by verifier: events, failures, denials, each verdict, total time."""
    of = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    kinds = [of(F.col("verdict_type") == v).alias(f"{v}_verdicts") for v in ("pass", "repair", "reject", "escalate")]
    return trace.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("events"), of(~F.col("success")).alias("failed"), of(F.col("type") == "tool.denied").alias("denied"), *kinds, F.coalesce(F.sum("elapsed_ns"), F.lit(0)).alias("elapsed_ns"))


def run_summary(trace: DataFrame) -> DataFrame:
    """run, started, ended, success, turns, tool_calls, escalated of each run in a trace."""
    of = lambda t: F.count_if(F.col("type") == t)
    return trace.groupBy("run").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.max(F.when(F.col("type") == "run.ended", F.col("success"))).alias("success"), of("model.started").alias("turns"),
        of("tool.requested").alias("tool_calls"), (of("escalation") > 0).alias("escalated"), of("repair.scheduled").alias("repairs"), F.max(F.when(F.col("type") == "budget.exhausted", F.col("kind"))).alias("exhausted"),
    )


def temperature(step: Column, base: float = 0.3, rise: float = 0.25, most: float = 1.0) -> Column:
    """Sampling temperature of each candidate, from 0."""
    return F.least(F.lit(base) + F.lit(rise) * step, F.lit(most))
