"""Trace, budget and relational queries over events and the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwell.operators import trace as TR
from tarnwell.plans._registry import registry, table

QUERIES, query = registry()


@query("select event_type, user_id, count(*) as events, round(sum(value), 4) as total, grouping_id(event_type, user_id)::bigint as level from events group by rollup (event_type, user_id)")
def trace_rollup(s, d):
    return TR.rollup(table(s, d, "events"), "event_type", "user_id")


@query(
    """with l as (select event_type, list(value order by value) as v from events group by event_type)
select event_type, len(v) as n, round(list_sum(v), 4) as total, v[1] as low, v[-1] as high, round(list_avg(v), 6) as mean, v[floor((len(v) - 1) * 0.5)::int + 1] as p50, v[floor((len(v) - 1) * 0.95)::int + 1] as p95, v[floor((len(v) - 1) * 0.99)::int + 1] as p99 from l"""
)
def latency_percentiles(s, d):
    return TR.latency_stats(table(s, d, "events"), "event_type", "value")


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as events, round(sum(value), 4) as total from events group by all")
def metrics_hourly_window(s, d):
    w = table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "events", "total")


@query(
    """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 6 hour then 1 else 0 end as new from events),
n as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from g)
select user_id, session::bigint as session, min(ts) as started, max(ts) as ended, count(*) as events from n group by all"""
)
def session_gaps(s, d):
    return TR.sessions(table(s, d, "events"), "user_id", "ts", "event_id", 6 * 3600)


@query()
def breaker_states(s, d):
    """An error is a failure of its user's signal; no SQL twin, as states depend on all before."""
    e = table(s, d, "events").withColumn("bad", F.col("event_type") == "error")
    return TR.breakers(e, "user_id", "ts", "event_id", "bad", 2, 3600.0)


@query(
    """with u as (select *, sum(value) over (partition by user_id order by ts, event_id) as used from events)
select event_id, round(used, 4) as used, used > 500 and used - value <= 500 as crossed from u"""
)
def token_ledger(s, d):
    return TR.budget_use(table(s, d, "events"), "user_id", ["ts", "event_id"], "value", 500.0).select("event_id", "used", "crossed")


@query(
    """with u as (select event_id, row_number() over w as turns, sum((event_type = 'click')::int) over w as calls, sum((event_type = 'error')::int) over w as repairs, sum(value) over w as spent from events window w as (partition by user_id order by ts, event_id))
select event_id, case when turns + 1 > 40 then 'turns' when calls + 1 > 16 then 'toolCalls' when repairs + 1 > 12 then 'repairs' when spent >= 900 then 'outputTokens' end as exhausted from u"""
)
def budget_exhaustion(s, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    hits = lambda t: F.sum((F.col("event_type") == t).cast("int")).over(w)
    usage = {"turns": F.count("*").over(w), "toolCalls": hits("click"), "repairs": hits("error"), "outputTokens": F.sum("value").over(w)}
    limits = {"turns": 40, "toolCalls": 16, "repairs": 12, "outputTokens": 900.0}
    return table(s, d, "events").select("event_id", TR.exhausted(usage, limits).alias("exhausted"))


@query(
    """with l as (select *, row_number() over (partition by user_id, props order by ts desc, event_id desc) as n from events)
select user_id, props, event_id, value from l where n = 1 and event_type <> 'error'"""
)
def kv_latest(s, d):
    """Events as a log of sets and, where they are errors, deletes."""
    log = table(s, d, "events").withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("set"))
    return TR.latest(log, ["user_id", "props"], ["ts", "event_id"]).select("user_id", "props", "event_id", "value")


@query(
    """with a as (select o_custkey as run, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as step, o_totalprice / 500000.0::double as confidence from orders),
n as (select *, row_number() over (partition by run order by (confidence >= 0.5)::int desc, case when confidence >= 0.5 then step end nulls last, step desc) as n from a)
select run, step::int as step, round(confidence, 6) as confidence from n where n = 1"""
)
def routing_ladder(s, d):
    """A customer's orders are the attempts of a run."""
    from pyspark.sql import Window as W

    step = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    a = table(s, d, "orders").select(F.col("o_custkey").alias("run"), step.alias("step"), (F.col("o_totalprice") / F.lit(500000.0)).alias("confidence"))
    return TR.routed(a, "run", "step", "confidence", 0.5).withColumn("confidence", F.round("confidence", 6))


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def pricing_summary(s, d):
    li = table(s, d, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("select n_name, count(distinct o_custkey) as customers, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def revenue_by_nation(s, d):
    """A four-way join: the small dimension is broadcast by its size, the facts meet on the order key."""
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count_distinct("o_custkey").alias("customers"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O')")
def semi_anti(s, d):
    c, o = table(s, d, "customer").select("c_custkey"), table(s, d, "orders")
    with_ = c.join(o.filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return with_.join(o.filter("o_orderstatus = 'O'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("(select user_id, event_id % 20 as slot from events where event_type = 'click' intersect select user_id, event_id % 20 from events where event_type = 'purchase') except select user_id, event_id % 20 from events where event_type = 'signup' and value > 19.9")
def set_operations(s, d):
    e = table(s, d, "events")
    of = lambda c: e.filter(c).select("user_id", (F.col("event_id") % 20).alias("slot"))
    return of("event_type = 'click'").intersect(of("event_type = 'purchase'")).exceptAll(of("event_type = 'signup' and value > 19.9").distinct())


@query("select event_type, user_id, rank() over (partition by event_type order by total desc) as rk, dense_rank() over (partition by event_type order by total desc) as dr, total from (select event_type, user_id, round(sum(value), 4) as total from events group by all)")
def ranking_windows(s, d):
    from pyspark.sql import Window as W

    g = table(s, d, "events").groupBy("event_type", "user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    w = W.partitionBy("event_type").orderBy(F.desc("total"))
    return g.select("event_type", "user_id", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), "total")
