"""Memory queries: each event is a fact of its user, whose slot is the event's type."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.operators import memory as M
from tarnwell.plans._registry import registry, table, toks

QUERIES, query = registry()

_NOW = "timestamp '2024-01-31 00:00:00'"


def now():
    """The queries' present; a function, as columns need a session."""
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


_FACTS = f"""
f0 as (
  select lpad(event_id::varchar, 12, '0') as id, user_id::varchar as thread_id, 'user' as subject, event_type as predicate, event_type || ' ' || value::decimal(18, 2)::varchar || ' ' || props as text,
    case event_id % 5 when 0 then 'userStated' when 1 then 'assistantStated' when 2 then 'toolOutput' when 3 then 'retrievedDocument' else 'derived' end as origin,
    (50 + event_id % 50) / 100.0::double as confidence, (1 + event_id % 10)::int as importance, case when event_id % 4 = 0 then ['core'] when event_id % 4 = 1 then ['ephemeral'] else []::varchar[] end as tags,
    ts as valid_from, lead(ts) over (partition by user_id, event_type order by ts, event_id) as valid_until, ts as recorded_at,
    case when event_id % 6 = 0 then ts + interval 7 day end as expires_at, lag(lpad(event_id::varchar, 12, '0')) over (partition by user_id, event_type order by ts, event_id) as supersedes
  from events),
facts as (select *, valid_until as invalidated_at, recorded_at as last_accessed_at, 0 as access_count from f0),
live as (select * from facts where valid_from <= {_NOW} and (valid_until is null or valid_until > {_NOW}) and (expires_at is null or expires_at > {_NOW}) and invalidated_at is null)"""


def _facts(s, d):
    e = table(s, d, "events")
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    n = F.col("event_id")
    fid = F.lpad(n.cast("string"), 12, "0")
    pick = F.element_at(F.array(*map(F.lit, ["userStated", "assistantStated", "toolOutput", "retrievedDocument", "derived"])), (n % 5 + 1).cast("int"))
    tags = F.when(n % 4 == 0, F.array(F.lit("core"))).when(n % 4 == 1, F.array(F.lit("ephemeral"))).otherwise(F.array().cast("array<string>"))
    until = F.lead("ts").over(w)
    return e.select(
        fid.alias("id"), F.col("user_id").cast("string").alias("thread_id"), F.lit("user").alias("subject"), F.col("event_type").alias("predicate"),
        F.concat_ws(" ", "event_type", F.col("value").cast("decimal(18,2)").cast("string"), "props").alias("text"), pick.alias("origin"), ((50 + n % 50) / F.lit(100.0)).alias("confidence"),
        (1 + n % 10).cast("int").alias("importance"), tags.alias("tags"), F.col("ts").alias("valid_from"), until.alias("valid_until"), F.col("ts").alias("recorded_at"), until.alias("invalidated_at"),
        F.when(n % 6 == 0, F.col("ts") + F.expr("interval 7 days")).alias("expires_at"), F.lag(fid).over(w).alias("supersedes"), F.col("ts").alias("last_accessed_at"), F.lit(0).alias("access_count"),
    )


@query(f"with {_FACTS} select id, thread_id, predicate, text from live where confidence >= 0.6 and origin in ('userStated', 'assistantStated', 'toolOutput')")
def facts_live(s, d):
    return M.query(_facts(s, d), now(), least_confidence=0.6, least_origin="toolOutput").select("id", "thread_id", "predicate", "text")


_PICKED = "select id, row_number() over (order by {0}) as place from facts where predicate = 'click' and valid_from <= timestamp '2024-01-20' and (valid_until is null or valid_until > timestamp '2024-01-20') and (expires_at is null or expires_at > timestamp '2024-01-20')"


def _picked(s, d, order):
    at = F.lit("2024-01-20").cast("timestamp_ntz")
    got = M.query(_facts(s, d), now(), as_of=at, slot=("User ", "CLICK"), order=order, limit=25)
    keys = [F.desc(k) for k in M.ORDERS[order]]
    return got.select("id", F.row_number().over(W.orderBy(*keys, "id")).alias("place"))  # 25 rows


@query(f"with {_FACTS} select * from ({_PICKED.format('id')}) where place <= 25")
def facts_by_id(s, d):
    return _picked(s, d, "idAscending")


@query(f"with {_FACTS} select * from ({_PICKED.format('recorded_at desc, id')}) where place <= 25")
def facts_by_record(s, d):
    return _picked(s, d, "recordedAtDescending")


@query(f"with {_FACTS} select * from ({_PICKED.format('valid_from desc, id')}) where place <= 25")
def facts_by_validity(s, d):
    return _picked(s, d, "validFromDescending")


@query(
    f"""with {_FACTS}, r as (select id, pow(0.5, greatest(epoch_us({_NOW}) - epoch_us(last_accessed_at), 0) / 3.6e9 / 72.0) as r, importance::double as i from facts where thread_id = '1'),
e as (select min(r) as rl, max(r) as rh, min(i) as il, max(i) as ih from r),
x as (select id, round(case when rh > rl then (r - rl) / (rh - rl) else 0 end + case when ih > il then (i - il) / (ih - il) else 0 end, 9) as salience from r, e),
y as (select id, row_number() over (order by salience desc, id) as place from x)
select id from y where place <= 40"""
)
def facts_by_salience(s, d):
    return M.query(_facts(s, d), now(), thread="1", all_time=True, order="salience", limit=40).select("id")


@query(f"with {_FACTS}, i as (select thread_id, unnest(generate_series(timestamp '2024-01-05', timestamp '2024-01-25', interval 5 day)) as instant from (select distinct thread_id from facts)) select i.thread_id, instant, count(*) as facts, min(id) as first_id from i join facts f on f.thread_id = i.thread_id and valid_from <= instant and (valid_until is null or valid_until > instant) and (expires_at is null or expires_at > instant) group by all")
def facts_as_of(s, d):
    """Facts valid at five instants for every thread: an interval join inside the thread."""
    f = _facts(s, d)
    at = F.explode(F.expr("sequence(timestamp_ntz'2024-01-05', timestamp_ntz'2024-01-25', interval 5 days)")).alias("instant")
    return M.valid_at_instants(f, f.select("thread_id").distinct().select("thread_id", at), "instant", ["thread_id"]).groupBy("thread_id", "instant").agg(F.count("*").alias("facts"), F.min("id").alias("first_id"))


@query("with p as (select user_id, ts as at, event_id from events where event_type = 'purchase'), c as (select user_id, ts, value from events where event_type = 'click') select p.user_id, p.at, p.event_id, c.value from p asof left join c on p.user_id = c.user_id and p.at >= c.ts")
def asof_join(s, d):
    """Each purchase with the value of the user's last click."""
    e = table(s, d, "events")
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("at"), "value")
    probes = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), "event_id")
    out = M.latest_before(clicks, probes.select("user_id", "at"), ["user_id"], "at", "value")
    return probes.join(out.dropDuplicates(["user_id", "at"]), ["user_id", "at"])


@query(
    f"""with {_FACTS},
c as (select thread_id, id, t, count(*) as n from (select thread_id, id, unnest({toks('text')}) as t from facts where invalidated_at is null) group by all),
tot as (select id, sum(n) as total from c group by id),
m as (select a.thread_id, a.id as id, b.id as other, sum(least(a.n, b.n)) as m from c a join c b on a.thread_id = b.thread_id and a.t = b.t and a.id < b.id group by all)
select m.thread_id, m.id, other, round(m / (x.total + y.total - m), 6) as score from m join tot x on x.id = m.id join tot y on y.id = other"""
)
def facts_similar(s, d):
    """Similarity of all open facts of a thread; at most one is open in each slot."""
    f = _facts(s, d).filter("invalidated_at is null")
    out = M.weighted_jaccard(f, f.withColumnRenamed("id", "other"), "id", "other", "text", ["thread_id"], F.col("id") < F.col("other"))
    return out.withColumn("score", F.round("score", 6))


@query(
    f"""with {_FACTS},
r as (select *, pow(0.5, greatest(epoch_us({_NOW}) - epoch_us(last_accessed_at), 0) / 3.6e9 / 72.0) as r from live),
w as (select *, min(r) over t as r0, max(r) over t as r1, min(importance) over t as i0, max(importance) over t as i1 from r window t as (partition by thread_id))
select id, thread_id, round(case when r1 > r0 then (r - r0) / (r1 - r0) else 0 end + case when i1 > i0 then (importance - i0)::double / (i1 - i0) else 0 end, 6) as salience from w"""
)
def salience(s, d):
    f = _facts(s, d)
    return M.salience(f.filter(M.is_live(now())), now(), ["thread_id"]).select("id", "thread_id", F.round("salience", 6).alias("salience"))


@query(
    f"""with {_FACTS},
a as (select *, (epoch_us({_NOW}) - epoch_us(last_accessed_at)) / 8.64e10 as age from facts where invalidated_at is null)
select id, case when coalesce(expires_at <= {_NOW}, false) or (list_contains(tags, 'ephemeral') and age >= 3) then 'expired' when origin = 'derived' and age >= 5 then 'idle' else 'decayed' end as reason
from a where coalesce(expires_at <= {_NOW}, false) or (list_contains(tags, 'ephemeral') and age >= 3) or (origin = 'derived' and age >= 5) or confidence * pow(0.5, age / 4.0) < 0.2"""
)
def forget_sweep(s, d):
    return M.sweep(_facts(s, d), now(), {"ephemeral": 3}, idle_days=5, half_life_days=4)


def _candidates(s, d):
    """A claim for every (user, type): the live fact's slot again, later or earlier, with other words or the same id."""
    f = _facts(s, d).filter(M.is_live(now()))
    n = F.col("id").cast("bigint")
    fid = F.when(n % 7 == 0, F.col("id")).otherwise(F.concat(F.lit("c"), "id"))
    start = F.when(n % 3 == 0, F.col("valid_from") + F.expr("interval 1 hour")).when(n % 3 == 1, F.col("valid_from")).otherwise(F.col("valid_from") - F.expr("interval 1 hour"))
    origin = F.element_at(F.array(*map(F.lit, ["userStated", "derived", "toolOutput"])), (n % 3 + 1).cast("int"))
    return f.select(
        fid.alias("id"), "thread_id", "subject", F.when(n % 5 == 0, F.lit("new slot")).otherwise(F.col("predicate")).alias("predicate"), F.concat("text", F.lit(" again")).alias("text"),
        F.when(n % 4 == 0, "userStated").otherwise(origin).alias("origin"), ((45 + n % 55) / F.lit(100.0)).alias("confidence"), F.lit(5).alias("importance"), F.array().cast("array<string>").alias("tags"), start.alias("valid_from"), (n % 11 == 0).alias("retraction"),
    )


_DECIDED = f"""{_FACTS},
cand as (
  select case when id::bigint % 7 = 0 then id else 'c' || id end as id, thread_id, case when id::bigint % 5 = 0 then 'new slot' else predicate end as predicate, text || ' again' as text,
    case when id::bigint % 4 = 0 then 'userStated' else ['userStated', 'derived', 'toolOutput'][id::bigint % 3 + 1] end as origin, (45 + id::bigint % 55) / 100.0::double as confidence,
    case id::bigint % 3 when 0 then valid_from + interval 1 hour when 1 then valid_from else valid_from - interval 1 hour end as valid_from, id::bigint % 11 = 0 as retraction
  from live),
tr as (select * from (values ('userStated', 4), ('assistantStated', 3), ('toolOutput', 2), ('retrievedDocument', 1), ('derived', 0)) t(origin, trust)),
j as (
  select c.*, ct.trust as c_trust, l.id as f_id, l.confidence as f_conf, l.valid_from as f_from, lt.trust as f_trust, x.id is not null as duplicate
  from cand c join tr ct on ct.origin = c.origin left join live l on l.thread_id = c.thread_id and l.predicate = c.predicate left join tr lt on lt.origin = l.origin left join live x on x.id = c.id),
decided as (
  select id, case when (origin <> 'userStated' and confidence < 0.9) or confidence < 0.5 then 'noop' when retraction and f_id is not null then 'delete' when retraction or duplicate then 'noop'
    when f_id is null then 'add' when valid_from > f_from or (valid_from = f_from and (confidence > f_conf or (confidence = f_conf and c_trust > f_trust))) then 'update' else 'noop' end as operation,
  case when origin <> 'userStated' and confidence < 0.9 then 'lowerTrustRejected' when confidence < 0.5 then 'belowConfidenceFloor' when retraction then 'retractionRequested' when duplicate then 'duplicateOfCurrent'
    when f_id is null then 'noSimilarFact' when valid_from > f_from then 'newerWins' when valid_from < f_from then 'staleCandidate' when confidence <> f_conf then 'higherConfidenceWins'
    when c_trust <> f_trust then 'higherTrustWins' else 'slotContradiction' end as rationale, f_id, valid_from
  from j)"""


@query(f"with {_DECIDED} select id, operation, rationale from decided")
def reconcile(s, d):
    return M.reconcile(_candidates(s, d), _facts(s, d), now()).select("id", "operation", "rationale")


@query(
    f"""with {_DECIDED},
ended as (select f_id as id, min(case when operation = 'update' then valid_from end) as until from decided where operation in ('update', 'delete') group by f_id)
select count(*) + (select count(*) from decided d where operation in ('add', 'update') and not exists (select 1 from facts f where f.id = d.id)) as facts,
  count(*) filter (facts.invalidated_at is null and ended.id is null) + (select count(*) from decided d where operation in ('add', 'update') and not exists (select 1 from facts f where f.id = d.id)) as open_facts,
  (select count(*) from decided where rationale = 'duplicateOfCurrent')::bigint as touches
from facts left join ended on facts.id = ended.id"""
)
def reconcile_apply(s, d):
    f, c = _facts(s, d), _candidates(s, d)
    after = M.apply_decisions(f, c, M.reconcile(c, f, now()), now())
    return after.agg(F.count("*").alias("facts"), F.count_if(F.col("invalidated_at").isNull()).alias("open_facts"), F.sum("access_count").alias("touches"))


@query(
    """with recursive e as (select lpad(event_id::varchar, 12, '0') as id, lag(lpad(event_id::varchar, 12, '0')) over (partition by user_id, event_type order by ts, event_id) as supersedes from events),
up(id, step) as (select id, 0 from e where id = '000000000100' union all select c.supersedes, u.step - 1 from up u join e c on c.id = u.id where c.supersedes is not null),
down(id, step) as (select id, 0 from e where id = '000000000100' union all select c.id, w.step + 1 from down w join e c on c.supersedes = w.id)
select id, step::int as step from up union select id, step::int from down"""
)
def supersession_chain(s, d):
    return M.chain(_facts(s, d).select("id", "supersedes"), "000000000100")


@query("with n as (select lpad(event_id::varchar, 12, '0') as id, row_number() over (order by event_id) - 1 as step from events where event_id < 3000) select id, (step - (select step from n where id = '000000000100'))::int as step from n")
def long_chain(s, d):
    """A chain of up to 3000 facts, each in place of the one before."""
    e = table(s, d, "events").filter("event_id < 3000").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"))
    return M.chain(e.select("id", F.lag("id").over(W.orderBy("id")).alias("supersedes")), "000000000100")


@query(f"with {_FACTS} select thread_id, count(*) as facts from facts where not (list_contains(tags, 'ephemeral') and recorded_at < timestamp '2024-01-15') group by thread_id")
def purge_exact(s, d):
    return M.purge(_facts(s, d), tags_any=["ephemeral"], older_than=F.lit("2024-01-15").cast("timestamp_ntz")).groupBy("thread_id").agg(F.count("*").alias("facts"))


@query(
    """with u as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn) as u from conversations),
n as (select *, (u - min(u) over (partition by conv_id))::int as ordinal from u)
select conv_id, ordinal, min(turn) as first_turn, max(turn) as last_turn, md5(string_agg(role || ': ' || text, chr(10) order by turn)) as digest from n group by conv_id, ordinal"""
)
def conversation_rounds(s, d):
    return M.rounds(table(s, d, "conversations")).select("conv_id", "ordinal", "first_turn", "last_turn", F.md5("display").alias("digest"))


@query(
    """with n as (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations)
select conv_id, count(*) filter (n > 3) as omitted, md5(case when count(*) filter (n > 3) > 0 then '(earlier ' || (count(*) filter (n > 3))::varchar || ' turn(s) omitted)' || chr(10) else '' end || string_agg(role || ': ' || text, chr(10) order by turn) filter (n <= 3)) as digest from n group by conv_id"""
)
def keep_recent(s, d):
    return M.keep_recent(table(s, d, "conversations"), 3).select("conv_id", "omitted", F.md5("transcript").alias("digest"))


@query(
    f"""with {_FACTS},
l as (select *, subject || ' ' || predicate || ': ' || text as line from live),
n as (select *, sum(length(line) + 1) over w - 1 as used, row_number() over w as n from l window w as (partition by thread_id order by importance desc, valid_from desc, id rows between unbounded preceding and current row))
select thread_id, count(*) as lines, md5(string_agg(line, chr(10) order by n)) as digest from n where used <= 100 group by thread_id"""
)
def core_block(s, d):
    f = _facts(s, d)
    return M.core_block(f.filter(M.is_live(now())), 100).select("thread_id", F.size(F.split("block", "\n")).cast("long").alias("lines"), F.md5("block").alias("digest"))
