"""Mixing sources to target weights by weighted exponential keys.

Each source's target is its weight's share of the mix, cut at `CAP` times its size; what is cut is shared anew by
weight until no target is above its cut. Capping in order of size over weight gives that fixed point in one pass over
the table of sources. A source is taken in whole epochs first; the rest of its target goes to the documents with the
smallest Efraimidis-Spirakis keys -ln(u) / weight, u drawn from a hash of doc_id, up to the document whose middle
passes the rest. The prefix sums run in three levels, over groups of ranges of the key, over a group's ranges, and
inside the one range where the rest ends, so that a source with a third of all rows is never sorted in one task.

Defined cases: null texts have size 0; the null source is a source of its own, last; a document without a weight has
weight 1; null doc_ids share one key, repeated rows too, and are ordered by size; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.llm._common import WORD, materialise, table

NAME = "op7_source_mix"
SHARE = 1.5
CAP = 2
CYCLE = (3, 1, 2)
SEED = "mix"
RANGES = 8192  # of keys per unit
GROUP = 256  # ranges summed together first


def sized(docs: DataFrame, weights: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, key. weights: doc_id, weight (positive)."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    if weights is None:
        out = out.withColumn("weight", F.lit(1.0))
    else:
        one = weights.groupBy("doc_id").agg(F.max("weight").alias("weight")).filter("weight > 0")
        out = out.join(one, "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return out.select("doc_id", "source", "size", (-F.log(u) / F.col("weight")).alias("key"))


def targets(sources: DataFrame, share: float = SHARE, cap: float = CAP, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """source, source_size, target from a table with one row (source, source_size) for each source."""
    named = W.orderBy(F.col("source").asc_nulls_last())
    every = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weighed = sources.withColumn("w", F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(F.row_number().over(named) - 1, F.lit(len(cycle))) + 1).cast("int")))
    weighed = weighed.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    leveled = weighed.withColumn("level", level).withColumn("capped", F.col("level") >= F.col("ratio"))
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    return leveled.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(final * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = SHARE, cap: float = CAP, cycle: tuple[int, ...] = CYCLE, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for each row of docs."""
    rows = materialise(sized(docs, weights, seed).withColumn("part", F.floor(F.least(F.col("key"), F.lit(64.0)) * RANGES)), "mix-sizes")
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    by_source = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    goal = targets(by_source, share, cap, cycle)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    parts = parts.withColumn("group", F.floor(F.col("part") / GROUP))
    groups = parts.groupBy("source", "group").agg(F.sum("part_size").alias("group_size"))
    groups = groups.select(F.col("source").alias("_of"), F.col("group").alias("_group"), (F.sum("group_size").over(W.partitionBy("source").orderBy("group")) - F.col("group_size")).alias("before"))
    run = F.sum("part_size").over(W.partitionBy("source", "group").orderBy("part")) - F.col("part_size")
    placed = parts.withColumn("run", run).join(groups, F.col("source").eqNullSafe(F.col("_of")) & (F.col("group") == F.col("_group")))
    placed = placed.select(F.col("source").alias("_source"), F.col("part").alias("_part"), "part_size", (F.col("before") + F.col("run")).alias("ahead"))
    placed = placed.join(goal, F.col("_source").eqNullSafe(F.col("source"))).drop("source")
    got = rows.join(placed, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    whole = F.col("ahead") + F.col("part_size") <= F.col("rest")
    edge = ~whole & (F.col("ahead") < F.col("rest"))
    columns = ["doc_id", "source", "size", "source_size", "target", "epochs", "chosen"]
    inner = W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("ahead") + F.coalesce(F.sum("size").over(inner), F.lit(0)) + F.col("size") / 2
    cut = got.filter(edge).withColumn("chosen", (middle <= F.col("rest")).cast("long")).select(*columns)
    clear = got.filter(~edge).withColumn("chosen", whole.cast("long")).select(*columns)
    out = clear.unionByName(cut).withColumn("copies", F.col("epochs") + F.col("chosen"))
    return out.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "copies")


def label_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents marked good weigh 2, those marked bad 0.5; the others weigh 1."""
    return table(spark, sf_dir, "labels").filter("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), label_weights(spark, sf_dir)).drop("source", "copies")


ORACLE_SQL = r"""
with good as (
  select doc_id, max(case when quality = 1 then 2.0::double else 0.5::double end) as weight
  from labels where quality is not null group by doc_id),
rows as (
  select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) as size,
    -ln((('0x' || substr(md5('mix:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double) / coalesce(g.weight, 1.0::double) as key
  from documents d left join good g on g.doc_id = d.doc_id),
src as (select source, sum(size)::double as s from rows group by source),
weighed as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as w, 2 * s as most from src),
leveled as (
  select *, most / w as ratio,
    (1.5 * sum(s) over () - coalesce(sum(most) over (order by most / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / (sum(w) over () - coalesce(sum(w) over (order by most / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level
  from weighed),
goal as (
  select source, s, case when level >= ratio then most else w * max(case when level < ratio then level end) over () end as target from leveled),
placed as (
  select r.*, g.s, g.target, case when g.s > 0 then floor(g.target / g.s) else 0 end as epochs,
    coalesce(sum(r.size) over (partition by r.source order by r.key, r.doc_id, r.size rows between unbounded preceding and 1 preceding), 0) + r.size / 2 as middle
  from rows r join goal g on r.source is not distinct from g.source)
select doc_id, size::bigint as size, s::bigint as source_size, round(target, 6) as target,
  (size * (epochs + case when middle <= target - epochs * s then 1 else 0 end))::bigint as taken
from placed
"""
