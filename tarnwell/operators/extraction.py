"""Facts from conversation turns by rules, with DataFrame functions only.

Turns are split into sentences; each rule may give one value a sentence. A sentence that takes something back gives
the values of what it names, or the thing itself. Dates are recognised by a pattern (`DATES`), an approximation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.functions import redaction as X
from tarnwell.functions import text as T
from tarnwell.operators.memory import TRUST, trust

#: fixed values: name, pattern, predicate, confidence, importance above the usual, tags; a rule without predicate
#: takes it from its first group
RULES = [
    ("identity", r"(?i)\b(?:my name is|call me)\s{1,4}([^,;:\n]{1,64})", "name", 0.9, 3, ["core"]),
    ("identity-copula", r"\b[Ii](?:\s{1,3}am|['’]m)\s{1,3}(\p{Lu}[\p{L}'’\-]{1,30}(?:\s\p{Lu}[\p{L}'’\-]{1,30}){0,2})", "name", 0.9, 3, ["core"]),
    ("preference-positive", r"(?i)\bi\s{1,3}(?:prefer|like|love|enjoy)\s{1,4}([^,;:\n]{1,80})", "prefers", 0.8, 2, ["preference"]),
    ("preference-negative", r"(?i)\bi\s{1,3}(?:dislike|hate|don['’]?t like|do not like|can['’]?t stand|cannot stand)\s{1,4}([^,;:\n]{1,80})", "dislikes", 0.8, 2, ["preference"]),
    ("attribute", r"(?i)\bmy\s{1,3}([a-z]{2,24}(?:\s[a-z]{2,24}){0,2})\s{1,3}is\s{1,4}([^,;:\n]{1,80})", None, 0.75, 1, []),
    ("location", r"(?i)\bi\s{1,3}(?:live|work)\s{1,3}in\s{1,4}([^,;:\n]{1,64})", "location", 0.85, 2, ["core"]),
    ("constraint", r"(?i)\bi(?:\s{1,3}am|['’]m)\s{1,3}(?:allergic to|unable to)\s{1,4}([^,;:\n]{1,64})", "constraint", 0.9, 3, ["core"]),
]
RETRACTIONS = [
    ("retraction", r"(?i)\b(?:forget (?:that|about)|delete|don['’]?t remember|do not remember)\s{1,4}([^,;:\n]{1,80})", 0.9),
    ("retraction-no-longer-true", r"(?i)^([^,;:\n]{1,80}?)\s{1,3}is no longer true$", 0.9),
]
CORRECTION = r"(?i)^(?:actually|no,|that['’]s wrong|i meant)[\s,]{0,3}([^\n]{1,400})"
ORIGINS = {"user": "userStated", "assistant": "assistantStated", "tool": "toolOutput", "system": "derived"}
_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,6}"
DATES = rf"(?i)\b(?:\d{{4}}-\d{{2}}-\d{{2}}|{_MONTH}\.? \d{{1,2}}(?:,? \d{{4}})?|\d{{1,2}} {_MONTH}(?: \d{{4}})?|today|tomorrow|yesterday|(?:next|last|this) (?:week|month|year|monday|tuesday|wednesday|thursday|friday|saturday|sunday))\b"
_KIND = "array<struct<rule:string,predicate:string,text:string,confidence:double,delta:int,tags:array<string>>>"


def _group(c: Column, pattern: str, group: int) -> Column:
    """The trimmed group; null where the pattern does not match or the group is blank."""
    return F.nullif(F.regexp_replace(F.regexp_extract(c, pattern, group), r"^\s+|\s+$", ""), F.lit(""))


def rule_values(c: Column, confidence: Column | None = None) -> Column:
    """What each rule finds in a sentence, in the rules' order."""

    def one(rule) -> Column:
        name, pattern, predicate, sure, delta, tags = rule

        def found(value: Column) -> Column:
            key = F.lit(predicate) if predicate else T.normalise(F.regexp_extract(c, pattern, 1))
            fields = F.struct(
                F.lit(name).alias("rule"), key.alias("predicate"), value.alias("text"), (F.lit(sure) if confidence is None else F.coalesce(confidence, F.lit(sure))).alias("confidence"),
                F.lit(delta).alias("delta"), F.array(*map(F.lit, tags)).cast("array<string>").alias("tags"),
            )
            return F.when(value.isNotNull(), fields)

        return T.let(_group(c, pattern, 2 if predicate is None else 1), found)

    return F.array_compact(F.array(*map(one, RULES))).cast(_KIND)


def spans(messages: DataFrame, thread: str = "conv_id", turn: str = "turn") -> DataFrame:
    """thread, turn, span, subject, predicate, text, rule, confidence, importance, tags, origin of each find.

    messages: thread, turn, role, text."""
    each = messages.select(thread, turn, "role", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("sentence", "s"))
    rest = _group(F.col("s"), CORRECTION, 1)
    told = each.select(thread, turn, "role", "sentence", F.col("s").rlike(DATES).alias("temporal"), rest.isNotNull().alias("corrects"), F.coalesce(rest, F.col("s")).alias("s"))
    taken = F.coalesce(*[F.when(_group(F.col("s"), p, 1).isNotNull(), F.struct(F.lit(n).alias("rule"), _group(F.col("s"), p, 1).alias("object"), F.lit(sure).alias("confidence"))) for n, p, sure in RETRACTIONS])
    told = told.withColumn("taken", taken)
    inner = T.let(F.struct("taken.object", "taken.confidence"), lambda x: rule_values(x["object"], x["confidence"]))
    bare = F.array(F.struct(F.col("taken.rule").alias("rule"), F.lit("retraction").alias("predicate"), F.col("taken.object").alias("text"), F.col("taken.confidence").alias("confidence"), F.lit(0).alias("delta"), F.array(F.lit("retraction")).alias("tags"))).cast(_KIND)
    found = F.when(F.col("taken").isNull(), rule_values(F.col("s"))).otherwise(T.let(inner, lambda x: F.when(F.size(x) > 0, x).otherwise(bare)))
    rows = told.withColumn("found", found).select(thread, turn, "role", "sentence", "temporal", "corrects", F.col("taken").isNotNull().alias("retraction"), F.posexplode("found").alias("nth", "f"))
    role = F.coalesce(*[F.when(F.col("role") == r, F.lit(o)) for r, o in ORIGINS.items()], F.lit("derived"))
    more = F.array_compact(F.array(F.when(F.col("temporal"), F.lit("temporal")), F.when(F.col("corrects"), F.lit("correction")), F.when(F.col("retraction"), F.lit("retraction"))))
    weight = F.lit(5) + F.col("f.delta") + F.when(role == "userStated", 1).otherwise(-2) + F.when(F.col("temporal"), 1).otherwise(0)
    order = W.partitionBy(thread, turn).orderBy("sentence", "nth")
    return rows.select(
        thread, turn, (F.row_number().over(order) - 1).alias("span"), F.lit("user").alias("subject"), F.col("f.predicate").alias("predicate"), F.col("f.text").alias("text"), F.col("f.rule").alias("rule"),
        F.col("f.confidence").alias("confidence"), F.greatest(F.lit(1), F.least(F.lit(10), weight)).alias("importance"), F.array_sort(F.array_distinct(F.concat("f.tags", more))).alias("tags"), role.alias("origin"), "retraction",
    )


def candidates(messages: DataFrame, thread: str = "conv_id", turn: str = "turn", most: int = 8, redactions=X.COMMON) -> DataFrame:
    """spans that stand word for word in the thread's message, hold nothing that a redactor changes, and are the first
    with their fact id in the turn; at most `most` a turn, as a prompt's budget demands."""
    found = spans(messages, thread, turn).join(messages.select(thread, turn, F.col("text").alias("_said")), [thread, turn])
    clean = found.filter(T.is_verbatim(F.col("text"), F.col("_said")) & (X.redact(F.col("text"), redactions) == F.col("text"))).drop("_said")
    named = clean.withColumn("id", T.fact_id(F.col(thread).cast("string"), F.col("subject"), F.col("predicate"), F.col("text")))
    first = named.withColumn("_n", F.row_number().over(W.partitionBy(thread, turn, "id").orderBy("span"))).filter("_n = 1")
    return first.withColumn("_n", F.row_number().over(W.partitionBy(thread, turn).orderBy("span"))).filter(F.col("_n") <= most).drop("_n")


def with_selector(found: DataFrame, selector: Column) -> DataFrame:
    """found limited to the spans that a selector (a boolean column, as of a pandas UDF) keeps; where it keeps none of a
    turn's spans, or gives null, the rules' own choice holds."""
    w = W.partitionBy(*[c for c in found.columns if c in ("conv_id", "thread_id", "turn")])
    kept = found.withColumn("_k", F.coalesce(selector, F.lit(False)))
    return kept.withColumn("_any", F.max("_k").over(w)).filter(F.col("_k") | ~F.col("_any")).drop("_k", "_any")


def lower_trust(a: Column, b: Column) -> Column:
    """The origin of lower rank."""
    return F.when(trust(a) <= trust(b), a).otherwise(b)


assert set(ORIGINS.values()) <= set(TRUST)
