"""Queries of extraction, archives, index upkeep, templates, search answers and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwell.functions import text as T
from tarnwell.operators import archive as A
from tarnwell.operators import consolidation as K
from tarnwell.operators import context as X
from tarnwell.operators import extraction as E
from tarnwell.operators import memory as M
from tarnwell.operators import retrieval as R
from tarnwell.plans._registry import registry, table, texts, toks
from tarnwell.plans.facts import _FACTS, _NOW, _facts, now
from tarnwell.plans.lexical import _bm25, _hits, _queries
from tarnwell.sources import jsonl as J

QUERIES, query = registry()

_SAID = [
    ("My name is Dana Okafor. I live in Lisbon", "identity:name:Dana Okafor|attribute:name:Dana Okafor|location:location:Lisbon"),
    ("I prefer tea, not coffee!", "preference-positive:prefers:tea"),
    ("My favourite  colour is dark blue", ""),
    ("my desk phone is 555-0181", "attribute:desk phone:555-0181"),
    ("Actually, I am allergic to shellfish", "constraint:constraint:shellfish"),
    ("forget that I live in Berlin", "location:location:Berlin"),
    ("my boss is no longer true", "retraction-no-longer-true:retraction:my boss"),
    ("delete the old list", "retraction:retraction:the old list"),
    ("nothing to see", ""),
    ("I hate spam", "preference-negative:dislikes:spam"),
]


def _messages(s, d):
    said = F.element_at(F.array(*[F.lit(x) for x, _ in _SAID]), (F.col("turn") % len(_SAID) + 1).cast("int"))
    return table(s, d, "conversations").select("conv_id", "turn", "role", said.alias("text"))


@query(
    "with t as (select conv_id, turn, ["
    + ", ".join(f"'{x}'" for _, x in _SAID)
    + f"][turn % {len(_SAID)} + 1] as found from conversations) select conv_id, turn, found from t where found <> ''"
)
def fact_spans(s, d):
    """Sentences with known facts, dealt to the turns of every conversation."""
    each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", F.concat_ws(":", "rule", "predicate", "text").alias("f")))), lambda x: x["f"]), "|")
    return E.spans(_messages(s, d)).groupBy("conv_id", "turn").agg(each.alias("found"))


@query()
def fact_candidates(s, d):
    """Candidates for memory; ids are hashes of normalised parts."""
    return E.candidates(_messages(s, d)).select("conv_id", "turn", "id", "predicate", "text", "confidence", "importance", "origin", "retraction")


@query()
def archive_rounds(s, d):
    """Rounds with ids and key lines; key lines are found in Python."""
    return A.archived_rounds(table(s, d, "conversations")).select("conv_id", "ordinal", "round_id", "first_turn", "last_turn", F.length("index_text").alias("n"))


@query(f"with d as (select doc_id, case when doc_id % 7 = 0 then 'replaced text' else text end as text from documents where doc_id % 10 <> 0), t as (select doc_id, unnest({toks('text')}) as term from d) select term, count(distinct doc_id) as df from t group by term")
def index_upkeep(s, d):
    """An index after upserts and removals counts as if it had been built from what is left."""
    docs = texts(s, d).select("doc_id", "text")
    index = A.index_upsert(docs, docs.filter("doc_id % 7 = 0").select("doc_id", F.lit("replaced text").alias("text")), "doc_id")
    index = A.index_remove(index, docs.filter("doc_id % 10 = 0"), "doc_id")
    posts, _ = R.postings(index, "doc_id", "text")
    return posts.groupBy("term").agg(F.count("*").alias("df"))


@query("select conv_id, count(*) as kept, min(turn) as first from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 4 group by conv_id")
def bounded_store(s, d):
    return J.keep_last(table(s, d, "conversations"), ["conv_id"], ["turn"], 4).groupBy("conv_id").agg(F.count("*").alias("kept"), F.min("turn").alias("first"))


@query("select p_partkey, 'Part ' || p_name || ' by ' || p_brand || ' costs ' || case when p_size % 3 = 0 then 'unknown' else p_size::varchar end as text, null::varchar as error from part where p_size % 2 = 0 union all select p_partkey, null, 'missing: brand' from part where p_size % 2 = 1")
def template_render(s, d):
    p = table(s, d, "part")
    t = X.render_template("Part {{name}} by {{ brand }} costs {{size}}", {"name": F.col("p_name"), "brand": F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), "size": F.when(F.col("p_size") % 3 != 0, F.col("p_size"))}, {"size": "unknown"})
    return p.select("p_partkey", t.alias("t")).select("p_partkey", "t.*")


@query(
    f"""with {_bm25()},
l as (select query_id, rank, '- [' || doc_id::varchar || '] ' || source || ' — ' || case when length(replace(text, chr(10), ' ')) > 320 then substr(replace(text, chr(10), ' '), 1, 320) || '…' else replace(text, chr(10), ' ') end as l from bm join documents using (doc_id) where rank <= 5),
a as (select query_id, string_agg(l, chr(10) order by rank) as answer from l group by query_id)
select item_id as query_id, md5(coalesce(answer, 'no results')) as digest from benchmark left join a on query_id = item_id"""
)
def search_tool(s, d):
    docs = texts(s, d).select("doc_id", "source", "text")
    answers = X.search_answers(_hits(s, d, 5), docs, "query_id", "doc_id", "source", "text")
    return X.with_no_results(answers, _queries(s, d), "query_id").select("query_id", F.md5("answer").alias("digest"))


@query()
def redacted_context(s, d):
    """Framed prompts with redacted sources and what was redacted; its parts have SQL twins of their own."""
    out = X.redacted_context(_queries(s, d), _hits(s, d, 5), texts(s, d).select("doc_id", "source", "text"), "query_id", "doc_id", "source", "text")
    return out.select("query_id", F.md5("prompt").alias("digest"), F.array_join("redactions", ",").alias("redactions"))


@query(
    f"""with {_FACTS},
q as (select thread_id, 'click purchase ' || thread_id as text, {toks("'click purchase ' || thread_id")} as q from (select distinct thread_id from facts)),
cl as (select *, subject || ' ' || predicate || ': ' || text as line from live where list_contains(tags, 'core')),
cn as (select *, sum(length(line) + 1) over w - 1 as used, row_number() over w as n from cl window w as (partition by thread_id order by importance desc, valid_from desc, id rows between unbounded preceding and current row)),
core as (select thread_id, 'core' as section, 1 as place, string_agg(line, chr(10) order by n) as text from cn where used <= 120 group by thread_id),
r as (select l.*, q, len(list_filter(q, lambda t: list_contains({toks("concat_ws(' ', subject, predicate, l.text)")}, t)))::double / len(q) as v, pow(0.5, greatest(epoch_us({_NOW}) - epoch_us(last_accessed_at), 0) / 3.6e9 / 72.0) as rec from live l join q using (thread_id) where not list_contains(tags, 'core')),
b as (select *, min(v) over t as v0, max(v) over t as v1, min(rec) over t as r0, max(rec) over t as r1, min(importance) over t as i0, max(importance) over t as i1 from r window t as (partition by thread_id)),
sal as (select *, round(case when r1 > r0 then (rec - r0) / (r1 - r0) else 0 end + case when i1 > i0 then (importance - i0)::double / (i1 - i0) else 0 end + case when v1 > v0 then (v - v0) / (v1 - v0) else 0 end, 9) as salience from b),
f as (select thread_id, subject || ' ' || predicate || ': ' || text as text, row_number() over (partition by thread_id order by salience desc, id) as place from sal),
u as (select *, sum(greatest(1, octet_length(encode(text)) // 4)) over (partition by thread_id order by place) as used from f where place <= 3)
select thread_id, section, place::int as place, text from core union all select thread_id, 'facts', place::int, text from u where used <= 20"""
)
def memory_context(s, d):
    """What the prompt of each thread remembers: the core block, then facts by relevance and salience; no rounds here."""
    f = _facts(s, d)
    q = f.select("thread_id").distinct().withColumn("text", F.concat(F.lit("click purchase "), "thread_id"))
    rounds = s.createDataFrame([], "thread_id string, round_id string, index_text string")
    return X.memory_context(q, f, rounds, now(), facts_kept=3, fact_tokens=20, core_chars=120)


@query("select item_id, copy::int as copy, md5(text || ' copy ' || copy::varchar) as digest from benchmark, range(3) r(copy)")
def near_copies(s, d):
    return X.near_copies(table(s, d, "benchmark"), "item_id", "text", 3).select("item_id", "copy", F.md5("content").alias("digest"))


@query(
    """with n as (select event_id, user_id, '{"type":"tool.completed","run":"r' || user_id::varchar || '","ts":' || event_id::varchar || ',"tool":"' || event_type || '","success":' || case when event_type = 'error' then 'false' else 'true' end || ',"elapsed_ns":' || (event_id * 10)::varchar || '}' as line from events)
select event_id, line ->> '$.type' as type, line ->> '$.run' as run, (line ->> '$.ts')::double as ts, line ->> '$.tool' as tool, (line ->> '$.success')::boolean as success, (line ->> '$.elapsed_ns')::bigint as elapsed_ns from n"""
)
def trace_decode(s, d):
    """Trace lines made of events, read back into typed columns."""
    e = table(s, d, "events")
    line = F.to_json(F.struct(F.lit("tool.completed").alias("type"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run"), F.col("event_id").alias("ts"), F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("success"), (F.col("event_id") * 10).alias("elapsed_ns")))
    return e.select("event_id", *[c for c in J.trace_columns(line)]).select("event_id", "type", "run", "ts", "tool", "success", "elapsed_ns")


@query(
    f"""with {_FACTS}, t as (select id from facts where id::bigint % 9 = 0)
select facts.id, case when t.id is not null then {_NOW} else last_accessed_at end as last_accessed_at, (case when t.id is not null then 1 else 0 end)::int as access_count,
  case when facts.id::bigint % 5 = 0 and invalidated_at is null then {_NOW} else invalidated_at end as invalidated_at from facts left join t on t.id = facts.id"""
)
def touch_invalidate(s, d):
    f = _facts(s, d)
    touched = M.touch(f, f.filter(F.col("id").cast("bigint") % 9 == 0).select("id").union(f.filter(F.col("id").cast("bigint") % 18 == 0).select("id")), now())
    return M.invalidate(touched, f.filter(F.col("id").cast("bigint") % 5 == 0).select("id"), now()).select("id", "last_accessed_at", "access_count", "invalidated_at")


@query("select doc_id, greatest(1, octet_length(encode(text)) // 4)::bigint as tokens, substr(replace(text, chr(10), ' '), 1, 120) || case when length(text) > 120 then '…' else '' end as line from documents")
def token_estimates(s, d):
    return texts(s, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.excerpt(F.col("text"), 120).alias("line"))


@query(
    """with n as (select event_type as tool, case when event_id % 5 = 0 then 'tool.denied' else 'tool.completed' end as type, event_type <> 'error' as success, ['pass', 'repair', 'reject', 'escalate'][user_id % 4 + 1] as verdict, event_id * 10 as elapsed from events)
select tool, count(*) as events, count(*) filter (not success) as failed, count(*) filter (type = 'tool.denied') as denied, count(*) filter (verdict = 'pass') as pass_verdicts, count(*) filter (verdict = 'repair') as repair_verdicts,
  count(*) filter (verdict = 'reject') as reject_verdicts, count(*) filter (verdict = 'escalate') as escalate_verdicts, sum(elapsed)::bigint as elapsed_ns from n group by tool"""
)
def tool_metrics(s, d):
    """Trace lines made of events, read and rolled up by tool."""
    from tarnwell.operators import trace as TR

    n = F.col("event_id")
    verdict = F.element_at(F.array(*map(F.lit, ["pass", "repair", "reject", "escalate"])), (F.col("user_id") % 4 + 1).cast("int"))
    line = F.to_json(F.struct(F.when(n % 5 == 0, "tool.denied").otherwise("tool.completed").alias("type"), F.lit("r").alias("run"), n.alias("ts"), F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("success"), F.struct(verdict.alias("type")).alias("verdict"), (n * 10).alias("elapsed_ns")))
    return TR.trace_metrics(table(s, d, "events").select(*J.trace_columns(line)), "tool")


@query()
def consolidate_batch(s, d):
    """The facts after one batch of turns; extraction has a twin in fact_spans, reconciliation in reconcile."""
    m = _messages(s, d).withColumn("created_at", F.expr("timestamp_ntz'2024-01-30 00:00:00'"))
    after, _ = K.consolidate(m, _facts(s, d), now())
    return after.groupBy("predicate").agg(F.count("*").alias("facts"), F.count_if(F.col("invalidated_at").isNull()).alias("open_facts"))
