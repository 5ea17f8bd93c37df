"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwell.operators import evals as E
from tarnwell.operators.retrieval import small
from tarnwell.plans._registry import registry, table
from tarnwell.plans.lexical import _DENSE, _bm25, _both, _dense
from tarnwell.sources.cuts import written

QUERIES, query = registry()

_METRICS = f"""{_DENSE},
got as (
  select query_id, count(*) as retrieved, count(*) filter (label = query_label) as hits, min(rank) filter (label = query_label) as first,
    sum(case when label = query_label then 1 / log2(rank + 1) else 0 end) as dcg
  from dr where rank <= 10 group by query_id),
rel as (
  select q.vec_id as query_id, count(*) as relevant from embeddings q join embeddings e on q.label = e.label and q.vec_id <> e.vec_id where q.vec_id % 100 = 0 group by all),
ideal as (select query_id, relevant, (select sum(1 / log2(i + 1)) from range(1, 11) t(i) where i <= relevant) as idcg from rel),
cases as (select vec_id as case_id, label from embeddings where vec_id % 100 = 0),
metrics as (
  select case_id, label, coalesce(retrieved, 0)::bigint as retrieved,
    round(case when relevant > 0 then coalesce(hits, 0)::double / relevant end, 9) as recall, round(case when retrieved > 0 then hits::double / retrieved end, 9) as precision,
    round(case when relevant > 0 then coalesce(1.0::double / first, 0) end, 9) as reciprocal_rank, round(case when idcg > 0 then coalesce(dcg, 0) / idcg end, 9) as ndcg
  from cases left join got on case_id = got.query_id left join ideal on case_id = ideal.query_id)"""


def _metrics(s, d):
    """A case's relevant vectors are counted by label, not listed; labels are looked up for what was found."""
    e = table(s, d, "embeddings").select("vec_id", "label")
    cases = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("case_id"), "label")
    results = written(_dense(s, d, 10).select(F.col("query_id").alias("case_id"), F.col("vec_id").alias("item_id"), "rank"), "dense-hits")
    gains = e.withColumnRenamed("vec_id", "item_id").join(small(results.join(cases, "case_id")), ["item_id", "label"]).select("case_id", "item_id", F.lit(1.0).alias("gain"))
    own = cases.groupBy("case_id", "label").agg(F.count("*").alias("m"))
    relevant = own.join(small(e.groupBy("label").agg(F.count("*").alias("n"))), "label").groupBy("case_id").agg(F.sum(F.col("m") * (F.col("n") - F.col("m"))).alias("relevant"))
    ideal = relevant.filter("relevant > 0").withColumn("idcg", E.equal_ideal(F.col("relevant"), 10))
    return E.retrieval_metrics(results, gains, cases, 10, ideal=ideal).join(cases, "case_id")


@query(f"with {_METRICS} select case_id, retrieved, round(recall, 6) as recall, round(precision, 6) as precision, round(reciprocal_rank, 6) as reciprocal_rank, round(ndcg, 6) as ndcg from metrics")
def retrieval_metrics(s, d):
    """Vectors of the query's label are relevant."""
    return _metrics(s, d).select("case_id", "retrieved", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank", "ndcg")])


@query(f"with {_METRICS} select label, count(*) as cases, round(avg(recall), 6) as mean_recall, round(avg(precision), 6) as mean_precision, round(avg(reciprocal_rank), 6) as mean_reciprocal_rank, round(avg(ndcg), 6) as mean_ndcg from metrics group by label")
def metrics_by_label(s, d):
    return E.mean_metrics(_metrics(s, d), "label")


@query(
    f"""with {_bm25()},
base as (select query_id, doc_id, rank as b from bm where rank <= 10),
sc2 as (select query_id, doc_id, row_number() over (partition by query_id order by matched desc, doc_id) as o from scored),
other as (select * from sc2 where o <= 10),
j as (select coalesce(base.query_id, other.query_id) as query_id, b, o from base full join other on base.query_id = other.query_id and base.doc_id = other.doc_id),
p as (select * from j where b is not null and o is not null),
t as (select x.query_id, sum(sign(y.o - x.o)) as agree from p x join p y on x.query_id = y.query_id and x.b < y.b group by all),
a as (select query_id, count(b) as u, count(*) filter (b is not null and o is not null) as shared, max(abs(b - o)) as max_shift, coalesce(bool_or(b = 1 and o = 1), false) as top_kept from j group by all)
select query_id, shared, round(case when u > 0 then shared::double / u end, 6) as overlap, top_kept, max_shift::int as max_shift, round(case when shared >= 2 then agree * 2.0::double / (shared * (shared - 1)) end, 6) as tau from a left join t using (query_id)"""
)
def rank_stability(s, d):
    """BM25 against the ranking by matched terms."""
    out = E.rank_stability(*_both(s, d, 10), "query_id", "doc_id")
    return out.select("query_id", "shared", F.round("overlap", 6).alias("overlap"), "top_kept", "max_shift", F.round("tau", 6).alias("tau"))


@query(f"with {_DENSE}, g as (select query_id, count(*) as retrieved, max(score) as top from dr where rank <= 10 group by all) select e.vec_id as case_id, coalesce(retrieved, 0) as retrieved, round(top, 6) as top_score, coalesce(top < 0.5, true) as abstained from embeddings e left join g on g.query_id = e.vec_id where e.vec_id % 100 = 0")
def abstention(s, d):
    hits = _dense(s, d, 10).withColumnRenamed("query_id", "case_id")
    cases = table(s, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("case_id"))
    out = E.abstentions(hits, cases, "case_id", "score", 0.5)
    return out.select("case_id", "retrieved", F.round("top_score", 6).alias("top_score"), "abstained")


@query(
    """with b as (select doc_id as case_id, quality = 1 as c, toxic = 0 as b from labels)
select round(avg(c::int), 9) as pass_rate, round(avg(b::int), 9) as baseline_rate, count(*) filter (b and not c) as regressions,
  round(avg(c::int), 9) >= 0.75 and round(avg(c::int), 9) >= round(avg(b::int), 9) - 0.1 as gate_open from b"""
)
def eval_gate(s, d):
    """The quality label stands for a candidate's passes, the toxic label for the baseline's failures."""
    lab = table(s, d, "labels").withColumnRenamed("doc_id", "case_id")
    return E.gate(lab.select("case_id", (F.col("quality") == 1).alias("passed")), lab.select("case_id", (F.col("toxic") == 0).alias("passed")), 0.75, 0.1)


@query("select source, lang, grouping_id(source, lang)::bigint as level, count(*) as cases, sum((quality = 1)::int)::bigint as passed, round(avg((quality = 1)::int), 6) as pass_rate from documents join labels using (doc_id) group by rollup (source, lang)")
def pass_rate_report(s, d):
    j = table(s, d, "documents").select("doc_id", "source", "lang").join(table(s, d, "labels"), "doc_id")
    ok = (F.col("quality") == 1).cast("int")
    return j.rollup("source", "lang").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("cases"), F.sum(ok).alias("passed"), F.round(F.avg(ok), 6).alias("pass_rate"))


@query(
    """with b as (select conv_id, regexp_replace(lower(trim(array_to_string(list_distinct(list(text)), ' '))), '\\s+', ' ', 'g') as x from conversations group by conv_id)
select conv_id, (contains(x, 'the')::int + contains(x, 'que')::int)::int as found, not contains(x, 'worthless') as clean from b"""
)
def memory_grade(s, d):
    texts = table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("t"))
    g = texts.select("conv_id", E.memory_grade(F.col("t"), F.array(F.lit("the"), F.lit("que")), F.array(F.lit("worthless"))).alias("g"))
    return g.select("conv_id", (2 - F.size("g.missing")).alias("found"), (F.size("g.forbidden") == 0).alias("clean"))


@query(
    """with c as (select l_orderkey as run_id, l_suppkey as candidate, l_quantity as weight, case when l_returnflag = 'R' then 'reject' when l_discount > 0.05 then 'repair' else 'pass' end as verdict from lineitem),
g as (select run_id, candidate, sum(case when verdict = 'pass' then weight else 0 end) as earned, sum(weight) as total, bool_or(verdict in ('reject', 'escalate')) as out from c group by all),
s as (select *, round(case when total = 0 then 1 else earned / total end, 9) as score from g)
select run_id, candidate, round(score, 6) as score, out as disqualified, row_number() over (partition by run_id order by out, case when out then 0 else score end desc, candidate) = 1 as chosen from s"""
)
def best_of_n(s, d):
    """An order stands for a run, its suppliers for candidates, its lines for weighted checks."""
    v = F.when(F.col("l_returnflag") == "R", "reject").when(F.col("l_discount") > 0.05, "repair").otherwise("pass")
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("candidate"), F.col("l_quantity").alias("weight"), v.alias("verdict"))
    return E.best_of_n(rows).withColumn("score", F.round("score", 6))


@query(
    """with t as (select conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as s from conversations),
p as (select a.conv_id, len(list_intersect(a.s, b.s))::double as i, len(a.s) + len(b.s) as u from t a join t b on a.conv_id = b.conv_id and a.turn < b.turn),
g as (select conv_id, count(*) as n from t group by all)
select conv_id, n::int as n, round(avg(case when u = 0 then 1 else i / (u - i) end), 6) as agreement from g left join p using (conv_id) group by all"""
)
def agreement(s, d):
    return E.agreement(table(s, d, "conversations"), "conv_id", "text")
