"""Prompts and their contexts: templates, search results, redacted context, memory sections, near-duplicate probes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.functions import redaction as X
from tarnwell.functions import text as T
from tarnwell.operators import memory as M
from tarnwell.operators import retrieval as R


# --- templates


def render_template(body: str, given: dict[str, Column], defaults: dict[str, str] | None = None, required: set[str] | None = None) -> Column:
    """(text, error) of a template with {{name}} places, values from columns; the error names what is wrong, else null."""
    defaults, names = defaults or {}, list(dict.fromkeys(re.findall(r"\{\{\s*(\w+)\s*\}\}", body)))
    unknown = sorted(set(given) - set(names) - (required or set()) - set(defaults))
    parts, missing = [], []
    for piece in re.split(r"(\{\{\s*\w+\s*\}\})", body):
        m = re.fullmatch(r"\{\{\s*(\w+)\s*\}\}", piece)
        if not m:
            parts.append(F.lit(piece))
            continue
        value = given.get(m[1], F.lit(None).cast("string")).cast("string")
        value = F.coalesce(value, F.lit(defaults[m[1]])) if m[1] in defaults else value
        missing.append(F.when(value.isNull(), F.lit(m[1])))
        parts.append(F.coalesce(value, F.lit("")))
    lacks = F.array_distinct(F.array_compact(F.array(*missing))) if missing else F.array().cast("array<string>")
    text = F.concat(*parts) if parts else F.lit("")
    error = F.when(F.lit(bool(unknown)), F.lit("unknown: " + ", ".join(unknown))).when(F.size(lacks) > 0, F.concat(F.lit("missing: "), F.array_join(lacks, ", "))).when(text.rlike(r"\{\{|\}\}"), F.lit("places are left"))
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def resolve_templates(wanted: DataFrame, templates: DataFrame, pins: DataFrame) -> DataFrame:
    """wanted (name, version, null for any) with the template's body: the asked version, else the pinned, else the last."""
    last = templates.groupBy("name").agg(F.max("version").alias("_last"))
    asked = wanted.join(R.small(pins.select("name", F.col("version").alias("_pin"))), "name", "left").join(R.small(last), "name", "left")
    asked = asked.withColumn("version", F.coalesce("version", "_pin", "_last")).drop("_pin", "_last")
    return asked.join(R.small(templates), ["name", "version"], "left")


# --- search and context


def search_answers(hits: DataFrame, docs: DataFrame, query: str, item: str, title: str, text: str, limit: int | None = None) -> DataFrame:
    """query, answer: "- [id] title — excerpt" lines of the first hits; limits are held between 1 and 20."""
    n = min(20, max(1, 5 if limit is None else limit))
    line = F.concat(F.lit("- ["), F.col(item).cast("string"), F.lit("] "), F.col(title), F.lit(" — "), T.excerpt(F.col(text), 320))
    shown = hits.filter(F.col("rank") <= n).select(query, item, "rank").join(docs.select(item, title, text), item)
    lines = shown.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("ls"))
    return lines.select(query, F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("answer"))


def with_no_results(answers: DataFrame, queries: DataFrame, query: str) -> DataFrame:
    return queries.select(query).distinct().join(answers, query, "left").fillna({"answer": "no results"})


def redacted_context(queries: DataFrame, hits: DataFrame, docs: DataFrame, query: str, item: str, title: str, text: str, scope: tuple[str, ...] = ("prompt", "sources"), rules=X.COMMON, limit: int = 5) -> DataFrame:
    """query, prompt, redactions: the question and its first sources, redacted where the scope says, then framed."""
    shown = hits.filter(F.col("rank") <= limit).select(query, item, "rank").join(docs.select(item, F.col(title).cast("string").alias("_title"), F.col(text).alias("_content")), item)
    clean = X.redact_with_names(F.col("_content"), rules) if "sources" in scope else F.struct(F.col("_content").alias("text"), F.array().cast("array<string>").alias("applied"))
    shown = shown.withColumn("_c", clean)
    src = F.struct("rank", F.col(item).cast("string").alias("id"), F.col("_title").alias("title"), F.col("_c.text").alias("content"), F.col("_c.applied").alias("applied"))
    grouped = shown.groupBy(query).agg(F.array_sort(F.collect_list(src)).alias("_s"))
    asked = X.redact_with_names(F.col(text), rules) if "prompt" in scope else F.struct(F.col(text).alias("text"), F.array().cast("array<string>").alias("applied"))
    all_ = queries.select(query, asked.alias("_q")).join(grouped, query, "left")
    none = F.array().cast("array<struct<rank:int,id:string,title:string,content:string,applied:array<string>>>")
    sources = F.coalesce(F.col("_s"), none)
    names = F.array_distinct(F.concat(F.col("_q.applied"), F.flatten(F.transform(sources, lambda s: s["applied"]))))
    return all_.select(query, R.render_prompt(F.col("_q.text"), sources).alias("prompt"), names.alias("redactions"))


# --- memory sections


def fitting(lines: DataFrame, group: list[str], order: list[Column], tokens: str, budget: int) -> DataFrame:
    """The first lines of each group whose tokens sum to the budget at most; the first that does not fit ends it."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("_used", F.sum(tokens).over(w)).filter(F.col("_used") <= budget).drop("_used")


def memory_context(questions: DataFrame, facts: DataFrame, rounds: DataFrame, now: Column, facts_kept: int = 6, fact_tokens: int = 160, rounds_kept: int = 3, round_tokens: int = 192, core_chars: int = 400) -> DataFrame:
    """thread_id, section (core, facts, archive), place, text: what a prompt of each thread remembers.

    questions (thread_id, text), facts as in memory, rounds (thread_id, round_id, index_text). Facts outside the core
    are scored by the share of the question's terms that they hold and by salience; rounds by that share alone."""
    terms = questions.select("thread_id", F.array_distinct(T.tokens(F.col("text"))).alias("_q"))
    share = lambda c: F.when(F.size("_q") == 0, 0.0).otherwise(F.size(F.array_intersect("_q", F.array_distinct(T.tokens(c)))) / F.size("_q"))
    live = facts.filter(M.is_live(now))
    core = live.filter(F.array_contains("tags", "core"))
    block = M.core_block(core.join(R.small(terms.select("thread_id")), "thread_id", "left_semi"), core_chars)
    rest = live.filter(~F.array_contains("tags", "core")).join(R.small(terms), "thread_id")
    line = F.concat("subject", F.lit(" "), "predicate", F.lit(": "), "text")
    ranked = M.salience(rest.withColumn("_v0", share(F.concat_ws(" ", "subject", "predicate", "text"))), now, ["thread_id"], F.col("_v0"))
    ranked = R.ranked(ranked.select("thread_id", "id", line.alias("text"), "salience"), "thread_id", [F.desc("salience"), F.asc("id")], facts_kept).withColumn("_t", T.token_estimate(F.col("text")))
    kept = fitting(ranked, ["thread_id"], [F.asc("rank")], "_t", fact_tokens)
    old = rounds.join(R.small(terms), "thread_id").withColumn("_v0", share(F.col("index_text"))).filter("_v0 > 0")
    old = R.ranked(old.select("thread_id", "round_id", F.col("index_text").alias("text"), "_v0"), "thread_id", [F.desc("_v0"), F.asc("round_id")], rounds_kept).withColumn("_t", T.token_estimate(F.col("text")))
    old = fitting(old, ["thread_id"], [F.asc("rank")], "_t", round_tokens)
    parts = block.select("thread_id", F.lit("core").alias("section"), F.lit(1).alias("place"), F.col("block").alias("text"))
    return parts.unionByName(kept.select("thread_id", F.lit("facts").alias("section"), F.col("rank").alias("place"), "text")).unionByName(old.select("thread_id", F.lit("archive").alias("section"), F.col("rank").alias("place"), "text"))


def near_copies(docs: DataFrame, item: str, text: str, copies: int, marker: str = " copy ") -> DataFrame:
    """item, copy, content: each text with a marker and a number after it, to probe how stable a ranking is."""
    return docs.select(item, text, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")).select(item, "copy", F.concat(F.col(text), F.lit(marker), F.col("copy").cast("string")).alias("content"))


def repair_prompt(prompt: Column, output: Column, verdict: Column, limit: int = 4096) -> Column:
    """The prompt that asks for a repair, the failing output cut at `limit` bytes; null where the verdict passes."""
    told = F.concat(prompt, F.lit("\n\nThe answer before was:\n"), T.truncate_utf8(output, limit), F.lit("\n\nIt failed: "), F.coalesce(verdict["diagnostic"]["message"], F.lit("")), F.lit("\nAnswer again without this fault."))
    return F.when(verdict["type"] != "pass", told)
