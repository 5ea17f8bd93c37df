"""Bi-temporal facts: queries, similarity, salience, reconciliation, forgetting, rounds and the core block.

facts(id, thread_id, subject, predicate, text, origin, confidence, importance, tags, valid_from, valid_until,
recorded_at, invalidated_at, expires_at, supersedes, last_accessed_at, access_count)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.functions import text as T
from tarnwell.operators.retrieval import small
from tarnwell.sources.cuts import written

TRUST = {"userStated": 4, "assistantStated": 3, "toolOutput": 2, "retrievedDocument": 1, "derived": 0}
SLOT = ["thread_id", "subject_n", "predicate_n"]
NEAR = 0.72


def trust(origin: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in TRUST.items():
        out = F.when(origin == name, rank).otherwise(out)
    return out


def with_slot(df: DataFrame) -> DataFrame:
    return df.withColumn("subject_n", T.normalise(F.col("subject"))).withColumn("predicate_n", T.normalise(F.col("predicate")))


def was_valid(at: Column) -> Column:
    """Half open: valid from its start, no longer at its end or expiry; invalidation does not count."""
    return (F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)) & (F.col("expires_at").isNull() | (F.col("expires_at") > at))


def is_live(now: Column) -> Column:
    return was_valid(now) & F.col("invalidated_at").isNull()


#: sort keys of a query's order; equal ones go by id
ORDERS = {"idAscending": [], "recordedAtDescending": ["recorded_at"], "validFromDescending": ["valid_from"], "salience": ["salience"]}


def query(
    facts: DataFrame, now: Column, thread: str | None = None, tags_any: list[str] | None = None, least_confidence: float | None = None, least_origin: str | None = None,
    as_of: Column | None = None, all_time: bool = False, slot: tuple[str, str] | None = None, order: str | None = None, limit: int = -1,
) -> DataFrame:
    """Facts of a thread, a slot (subject, predicate in any case and spacing), any of some tags, a least confidence and origin, that are
    live now, were valid at as_of, or all; in one of ORDERS and, if limit is not negative, the first of that order."""
    out = facts
    if thread is not None:
        out = out.filter(F.col("thread_id") == thread)
    if slot is not None:
        out = out.filter((T.normalise(F.col("subject")) == T.normalise(F.lit(slot[0]))) & (T.normalise(F.col("predicate")) == T.normalise(F.lit(slot[1]))))
    if tags_any:
        out = out.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags_any))))
    if least_confidence is not None:
        out = out.filter(F.col("confidence") >= least_confidence)
    if least_origin is not None:
        out = out.filter(trust(F.col("origin")) >= TRUST[least_origin])
    if not all_time:
        out = out.filter(was_valid(as_of) if as_of is not None else is_live(now))
    if order is None and limit < 0:
        return out
    keys = ORDERS[order or "salience"]
    if keys == ["salience"]:
        out = salience(out, now, [])
    out = out.orderBy(*[F.desc(k) for k in keys], "id")
    return (out if limit < 0 else out.limit(limit)).select(*facts.columns)


def valid_at_instants(facts: DataFrame, instants: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """Each instant with the facts valid then: an interval join inside the keys."""
    return instants.join(facts, keys).filter(was_valid(F.col(at)))


def latest_before(events: DataFrame, probes: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """As-of join: each probe with the value of the last event at or before it, by union and a running last()."""
    left = probes.select(*keys, at, F.lit(None).cast(events.schema[value].dataType).alias(value), F.lit(1).alias("_probe"))
    both = events.select(*keys, at, value, F.lit(0).alias("_probe")).unionByName(left)
    w = W.partitionBy(*keys).orderBy(at, "_probe", F.col(value)).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, True).over(w)).filter("_probe = 1").drop("_probe")


# --- similarity


def weighted_jaccard(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str, keys: list[str], right_only: Column | None = None) -> DataFrame:
    """left_id, right_id, score: sum of minima over sum of maxima of token counts, for pairs within the keys that share
    a token. As sum max = sum a + sum b - sum min, only shared tokens are joined."""

    def counted(df: DataFrame, name: str, n: str) -> DataFrame:
        each = df.select(*keys, F.col(name).alias(name), F.explode(T.tokens(F.col(text))).alias("_t"))
        return each.groupBy(*keys, name, "_t").agg(F.count("*").alias(n)).withColumn(f"{n}_all", F.sum(n).over(W.partitionBy(*keys, name)))

    met = counted(left, left_id, "_a").join(counted(right, right_id, "_b"), [*keys, "_t"])
    if right_only is not None:
        met = met.filter(right_only)
    shared = met.groupBy(*keys, left_id, right_id, "_a_all", "_b_all").agg(F.sum(F.least("_a", "_b")).alias("_m"))
    return shared.select(*keys, left_id, right_id, F.round(F.col("_m") / (F.col("_a_all") + F.col("_b_all") - F.col("_m")), 9).alias("score"))


# --- salience


def salience(df: DataFrame, now: Column, group: list[str], relevance: Column | None = None, half_life_hours: float = 72.0, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Adds salience: recency, importance and relevance, each min-max normalised in the group, weighted and summed."""
    hours = F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_accessed_at").cast("timestamp"))) / F.lit(3.6e9), F.lit(0.0))
    out = df.withColumn("_r", F.pow(F.lit(0.5), hours / half_life_hours)).withColumn("_i", F.col("importance").cast("double")).withColumn("_v", relevance if relevance is not None else F.lit(0.0))
    names = [f"_g{i}" for i in range(len(group))]
    ends = out.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names)]).agg(*[f(c).alias(f"{c}{e}") for c in ("_r", "_i", "_v") for e, f in (("l", F.min), ("h", F.max))])
    met = F.lit(True)  # a group's ends are one row, so no group is gathered
    for g, n in zip(group, names):
        met = met & F.col(g).eqNullSafe(F.col(n))
    out = out.join(ends if group else F.broadcast(ends), met)

    def scaled(c: str) -> Column:
        low, high = F.col(f"{c}l"), F.col(f"{c}h")
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0)

    total = sum(x * scaled(c) for x, c in zip(weights, ("_r", "_i", "_v")))
    return out.select(*[c for c in df.columns if c != "salience"], F.round(total, 9).alias("salience"))


# --- reconciliation


def reconcile(candidates: DataFrame, facts: DataFrame, now: Column, floor: str = "derived", other_confidence: float = 0.9, confidence: float = 0.5) -> DataFrame:
    """One decision for each candidate against one snapshot of the facts: operation, target_id, rationale.

    candidates have facts' columns id, thread_id, subject, predicate, text, origin, confidence, valid_from and
    retraction (boolean). Gates hold in order: trust, confidence of what users did not say, confidence, retraction,
    duplicate, contradiction in the slot (settled by start of validity, confidence, trust), addition."""
    cand = with_slot(candidates)
    live = with_slot(facts).filter(is_live(now)).withColumn("f_trust", trust(F.col("origin")))
    live = live.select(*SLOT, F.col("id").alias("f_id"), F.col("text").alias("f_text"), F.col("confidence").alias("f_conf"), F.col("valid_from").alias("f_from"), "f_trust")
    pairs = cand.select("id", *SLOT, "text").join(live.select("f_id", *SLOT, "f_text"), SLOT)
    score = weighted_jaccard(cand.select("id", *SLOT, "text"), live.select("f_id", *SLOT, F.col("f_text").alias("text")), "id", "f_id", "text", SLOT)
    near = pairs.select("id", "f_id").join(score.select("id", "f_id", "score"), ["id", "f_id"], "left").select("id", "f_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    rows = near.join(live.drop("thread_id", "subject_n", "predicate_n"), "f_id")
    late = (-F.unix_micros(F.col("f_from").cast("timestamp"))).alias("late")  # the newest first, then the smallest id
    rank = F.struct((F.col("score") < NEAR).alias("far"), (-F.col("score")).alias("unlike"), late, "f_id", "f_from", "f_conf", "f_trust")
    per = rows.groupBy("id").agg(F.min(rank).alias("best"), F.min(F.struct(late, "f_id")).alias("newest"))
    same = live.select(F.col("f_id").alias("id")).withColumn("duplicate", F.lit(True))
    all_ = cand.withColumn("c_trust", trust(F.col("origin"))).join(per, "id", "left").join(same, "id", "left")
    b = F.col("best")
    newer = F.col("valid_from") > b["f_from"]
    tie = F.col("valid_from") == b["f_from"]
    wins = newer | (tie & ((F.col("confidence") > b["f_conf"]) | ((F.col("confidence") == b["f_conf"]) & (F.col("c_trust") > b["f_trust"]))))

    def row(operation: str, target: Column, rationale: Column | str) -> Column:
        return F.struct(F.lit(operation).alias("operation"), target.alias("target_id"), (F.lit(rationale) if isinstance(rationale, str) else rationale).alias("rationale"))

    none = F.lit(None).cast("string")
    differs = F.when(F.col("confidence") != b["f_conf"], "higherConfidenceWins").when(F.col("c_trust") != b["f_trust"], "higherTrustWins")
    why = F.when(newer, "newerWins").when(~tie, "staleCandidate").otherwise(F.coalesce(differs, F.lit("slotContradiction")))
    decision = (
        F.when(F.col("c_trust") < TRUST[floor], row("noop", none, "lowerTrustRejected"))
        .when((F.col("origin") != "userStated") & (F.col("confidence") < other_confidence), row("noop", none, "lowerTrustRejected"))
        .when(F.col("confidence") < confidence, row("noop", none, "belowConfidenceFloor"))
        .when(F.col("retraction") & F.col("newest").isNotNull(), row("delete", F.col("newest.f_id"), "retractionRequested"))
        .when(F.col("retraction"), row("noop", none, "retractionRequested"))
        .when(F.col("duplicate"), row("noop", F.col("id"), "duplicateOfCurrent"))
        .when(b.isNotNull() & wins, row("update", b["f_id"], why))
        .when(b.isNotNull(), row("noop", b["f_id"], why))
        .otherwise(row("add", none, "noSimilarFact"))
    )
    return all_.select("id", decision.alias("d")).select("id", "d.*")


def apply_decisions(facts: DataFrame, candidates: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """The facts after a batch: each id inserted once, in place of a closed one of that id, targets closed at the earliest
    replacement's start, duplicates touched."""
    made = candidates.join(decisions, "id")
    new = made.filter(F.col("operation").isin("add", "update")).withColumn("supersedes", F.when(F.col("operation") == "update", F.col("target_id")))
    new = new.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("valid_from"))).filter("_n = 1")
    facts, fresh = facts.join(new.select("id"), "id", "left_anti").select(*facts.columns), new
    for c in facts.columns:
        if c not in fresh.columns:
            value = {"access_count": F.lit(0), "last_accessed_at": now}.get(c, F.lit(None))
            fresh = fresh.withColumn(c, value.cast(facts.schema[c].dataType))
    fresh = fresh.withColumn("recorded_at", now.cast(facts.schema["recorded_at"].dataType)).select(*[F.col(c).cast(facts.schema[c].dataType) for c in facts.columns])
    closing = made.filter(F.col("operation").isin("update", "delete")).groupBy(F.col("target_id").alias("id")).agg(F.min(F.when(F.col("operation") == "update", F.col("valid_from"))).alias("_until"), F.lit(True).alias("_close"))
    touched = made.filter("rationale = 'duplicateOfCurrent'").select("id", F.lit(True).alias("_touch")).distinct()
    old = facts.join(closing, "id", "left").join(touched, "id", "left")
    first = F.col("_close") & F.col("invalidated_at").isNull()
    when = now.cast(facts.schema["recorded_at"].dataType)
    changed = {
        "valid_until": F.when(first & F.col("_until").isNotNull(), F.col("_until")).otherwise(F.col("valid_until")),
        "invalidated_at": F.when(first, when).otherwise(F.col("invalidated_at")),
        "last_accessed_at": F.when(F.col("_touch"), F.greatest("last_accessed_at", when)).otherwise(F.col("last_accessed_at")),
        "access_count": F.when(F.col("_touch"), F.col("access_count") + 1).otherwise(F.col("access_count")),
    }
    return old.select(*[changed.get(c, F.col(c)).cast(facts.schema[c].dataType).alias(c) for c in facts.columns]).unionByName(fresh)


def _followed(links: DataFrame, seed: str) -> DataFrame:
    """id, step: what is reached from a seed by links (id, to), one from each id, by pointers that double in length."""
    links = written(links.filter("to is not null"), "links")
    found = written(links.sparkSession.createDataFrame([(seed, 0)], "id string, step long"), "reached")
    size, jump = 1, 1
    while True:
        more = found.join(links, "id").select(F.col("to").alias("id"), (F.col("step") + jump).alias("step"))
        found = written(found.unionByName(more).groupBy("id").agg(F.min("step").alias("step")), "reached")  # a ring comes back to known ids
        now = found.count()
        if now == size:
            return found
        size, jump = now, 2 * jump
        links = written(links.join(links.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")), "links")


def chain(facts: DataFrame, seed: str) -> DataFrame:
    """id, step: what a fact replaced (negative steps) and what replaced it, through the smallest id at each fork, of any
    length; a ring is followed once."""
    own = facts.select(F.col("id").cast("string").alias("id"), F.col("supersedes").cast("string").alias("to"))
    seeds = own.filter(F.col("id") == seed).select("id").distinct()
    known = own.groupBy("id").agg(F.min("to").alias("to")).join(own.select(F.col("id").alias("to")).distinct(), "to", "left_semi")
    after = own.filter("to is not null").groupBy("to").agg(F.min("id").alias("id")).select(F.col("to").alias("id"), F.col("id").alias("to"))
    steps = _followed(known, seed).select("id", (-F.col("step")).cast("int").alias("step")).union(_followed(after, seed).select("id", F.col("step").cast("int")))
    return steps.distinct().join(F.broadcast(seeds.select(F.lit(1).alias("_one"))), F.lit(True)).drop("_one")


def sweep(facts: DataFrame, now: Column, ttl_days: dict[str, float] | None = None, default_ttl: float | None = None, idle_days: float | None = 30.0, half_life_days: float | None = None, least: float = 0.2, live_cap: int | None = None) -> DataFrame:
    """id, reason for un-invalidated facts to forget: expired, idle, decayed, overCapacity (live ones past the thread's
    cap), the first that holds. Decay and the cap are off unless given."""
    open_ = facts.filter("invalidated_at is null")
    age = lambda c: (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(c).cast("timestamp"))) / F.lit(8.64e10)
    ttl = F.lit(None).cast("double")
    for tag, days in sorted((ttl_days or {}).items()):
        ttl = F.least(ttl, F.when(F.array_contains("tags", tag), float(days)))
    ttl = F.coalesce(ttl, F.lit(default_ttl).cast("double"))
    reason = (
        F.when(F.coalesce(F.col("expires_at") <= now, F.lit(False)) | F.coalesce(age("recorded_at") >= ttl, F.lit(False)), "expired")
    )
    if idle_days is not None:
        reason = reason.when((F.col("origin") == "derived") & (age("last_accessed_at") >= idle_days), "idle")
    if half_life_days:
        elapsed = F.greatest(age("last_accessed_at"), F.lit(0.0))
        reason = reason.when(F.col("confidence") * F.pow(F.lit(0.5), elapsed / half_life_days) < least, "decayed")
    judged = open_.withColumn("reason", reason)
    gone = judged.filter("reason is not null").select("id", "reason")
    if live_cap is None:
        return gone
    rest = salience(judged.filter("reason is null").filter(is_live(now)), now, ["thread_id"])
    w = W.partitionBy("thread_id").orderBy(F.desc("salience"), "id")
    return gone.unionByName(rest.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") > live_cap).select("id", F.lit("overCapacity").alias("reason")))


def purge(facts: DataFrame, thread: str | None = None, subject: str | None = None, tags_any: list[str] | None = None, older_than: Column | None = None) -> DataFrame:
    """The facts without those that meet all given conditions exactly; no condition removes nothing."""
    tests = []
    if thread is not None:
        tests.append(F.col("thread_id") == thread)
    if subject is not None:
        tests.append(T.normalise(F.col("subject")) == " ".join(subject.lower().split()))
    if tags_any:
        tests.append(F.arrays_overlap("tags", F.array(*map(F.lit, tags_any))))
    if older_than is not None:
        tests.append(F.col("recorded_at") < older_than)
    if not tests:
        return facts
    hit = tests[0]
    for t in tests[1:]:
        hit = hit & t
    return facts.filter(~F.coalesce(hit, F.lit(False)))


def upsert(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Facts with the new rows in place of those with their id; of repeated new ids the last recorded holds."""
    one = new.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("recorded_at")))).filter("_n = 1").drop("_n")
    return facts.join(small(one.select("id")), "id", "left_anti").select(*facts.columns).unionByName(one.select(*facts.columns))


def touch(facts: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Facts with the named ones read now: once each, however often they are named."""
    named = small(ids.select("id").distinct().withColumn("_hit", F.lit(True)))
    when = now.cast(facts.schema["last_accessed_at"].dataType)
    got = facts.join(named, "id", "left")
    return got.withColumn("last_accessed_at", F.when(F.col("_hit"), F.greatest("last_accessed_at", when)).otherwise(F.col("last_accessed_at"))).withColumn("access_count", F.col("access_count") + F.when(F.col("_hit"), 1).otherwise(0)).select(*facts.columns)


def invalidate(facts: DataFrame, ids: DataFrame, now: Column, until: Column | None = None) -> DataFrame:
    """Facts with the named open ones closed now; the end of their validity is set only if it is given."""
    got = facts.join(small(ids.select("id").distinct().withColumn("_hit", F.lit(True))), "id", "left")
    hit = F.col("_hit") & F.col("invalidated_at").isNull()
    if until is not None:
        got = got.withColumn("valid_until", F.when(hit, until.cast(facts.schema["valid_until"].dataType)).otherwise(F.col("valid_until")))
    return got.withColumn("invalidated_at", F.when(hit, now.cast(facts.schema["invalidated_at"].dataType)).otherwise(F.col("invalidated_at"))).select(*facts.columns)


def similar(facts: DataFrame, claims: DataFrame, now: Column, limit: int = 5) -> DataFrame:
    """claim, id, score, rank: live facts of the claim's thread by similarity of text; claims (claim, thread_id, text)."""
    live = facts.filter(is_live(now)).select("id", "thread_id", "text")
    score = weighted_jaccard(claims, live, "claim", "id", "text", ["thread_id"])
    w = W.partitionBy("claim").orderBy(F.desc("score"), "id")
    return score.withColumn("rank", F.row_number().over(w)).filter((F.col("score") > 0) & (F.col("rank") <= limit)).select("claim", "id", "score", "rank")


# --- conversations


def rounds(messages: DataFrame, thread: str = "conv_id", turn: str = "turn") -> DataFrame:
    """thread, ordinal, first_turn, last_turn, display: a round begins at each user message; what stands before is one."""
    w = W.partitionBy(thread).orderBy(turn)
    numbered = messages.withColumn("_u", F.sum((F.col("role") == "user").cast("int")).over(w))
    floor = F.min("_u").over(W.partitionBy(thread))
    numbered = numbered.withColumn("ordinal", (F.col("_u") - floor).cast("int"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("l"))))
    return numbered.groupBy(thread, "ordinal").agg(F.min(turn).alias("first_turn"), F.max(turn).alias("last_turn"), F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("display"))


def keep_recent(messages: DataFrame, keep: int = 12, thread: str = "conv_id", turn: str = "turn") -> DataFrame:
    """thread, omitted, transcript: the last messages, and a line that counts the earlier ones."""
    numbered = messages.withColumn("_n", F.row_number().over(W.partitionBy(thread).orderBy(F.desc(turn))))
    kept = F.array_sort(F.collect_list(F.when(F.col("_n") <= keep, F.struct(F.col(turn).alias("t"), F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("l")))))
    out = numbered.groupBy(thread).agg(F.count_if(F.col("_n") > keep).alias("omitted"), F.array_join(F.transform(kept, lambda x: x["l"]), "\n").alias("body"))
    note = F.when(F.col("omitted") > 0, F.concat(F.lit("(earlier "), F.col("omitted").cast("string"), F.lit(" turn(s) omitted)\n"))).otherwise("")
    return out.select(thread, "omitted", F.concat(note, "body").alias("transcript"))


def core_block(facts: DataFrame, cap: int = 400) -> DataFrame:
    """thread_id, block: lines by importance, then validity, then id, as many as fit."""
    order = W.partitionBy("thread_id").orderBy(F.desc("importance"), F.desc("valid_from"), "id")
    lines = facts.withColumn("_l", F.concat("subject", F.lit(" "), "predicate", F.lit(": "), "text")).withColumn("_n", F.row_number().over(order))
    run = F.sum(F.length("_l") + 1).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1
    kept = lines.withColumn("_len", run).filter(F.col("_len") <= cap)
    rows = F.array_sort(F.collect_list(F.struct("_n", "_l")))
    return kept.groupBy("thread_id").agg(F.array_join(F.transform(rows, lambda x: x["_l"]), "\n").alias("block"))
