"""Archived rounds and the indexes that serve them: key lines, index maintenance, removal from every index at once."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions import text as T
from tarnwell.operators import memory as M
from tarnwell.operators import retrieval as R

#: fixed values: words that are no entity and no unit
KEY_STOP_WORDS = set("a an and but he her his i if it its me my or our she that the their they this we you your".split())
_TOKEN = re.compile(r"[^\W_]+")
_QUANTITY = re.compile(r"\b([0-9]{1,12}(?:[.,][0-9]{1,6})?)[ \t]?([A-Za-z]{1,10})\b")
_MONTHS = "january february march april may june july august september october november december".split()
_DATE = re.compile(rf"\b(?:(?P<y1>\d{{4}})-(?P<m1>\d{{2}})-(?P<d1>\d{{2}})|(?P<m2>{'|'.join(_MONTHS)}) (?P<d2>\d{{1,2}}),? (?P<y2>\d{{4}})|(?P<d3>\d{{1,2}}) (?P<m3>{'|'.join(_MONTHS)}) (?P<y3>\d{{4}}))\b", re.I)


def date_keys(text: str) -> list[str]:
    """Dates with a written year, as yyyy-mm-dd; recognised by pattern."""
    out = []
    for m in _DATE.finditer(text):
        y, month, d = next((m[f"y{i}"], m[f"m{i}"], m[f"d{i}"]) for i in (1, 2, 3) if m[f"y{i}"])
        n = int(month) if month.isdigit() else _MONTHS.index(month.lower()) + 1
        if 1 <= n <= 12 and 1 <= int(d) <= 31:
            out.append(f"{y}-{n:02d}-{int(d):02d}")
    return out


def entity_keys(text: str) -> list[str]:
    """Runs of capitalised words inside a sentence, of which the first three count; only blanks join a run."""
    out: list[list[str]] = []
    before, open_ = None, False
    for m in _TOKEN.finditer(text):
        gap = text[before:m.start()] if before is not None else "."
        begins, word = bool(re.search(r"[.!?:\n]", gap)), m[0]
        named = not begins and len(word) > 1 and word[0].isupper() and word.lower() not in KEY_STOP_WORDS
        if named and open_ and not gap.strip(" \t"):
            out[-1].append(word)
        elif named:
            out.append([word])
        open_, before = named, m.end()
    return [" ".join(run[:3]) for run in out]


def quantity_keys(text: str) -> list[str]:
    return [f"{n} {u.lower()}" for n, u in _QUANTITY.findall(text) if u.lower() not in KEY_STOP_WORDS]


def key_line(text: str | None, most: int = 240) -> str:
    """Sorted distinct keys of a text, as many as fit."""
    kept, used = [], -1
    for key in sorted({*date_keys(text or ""), *entity_keys(text or ""), *quantity_keys(text or "")}):
        used += len(key) + 1
        if used > most:
            break
        kept.append(key)
    return " ".join(kept)


def key_lines(c: Column, most: int = 240) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: key_line(x, most))

    return run(c)


def archived_rounds(messages: DataFrame, ledger: DataFrame | None = None, thread: str = "conv_id", turn: str = "turn", domain: str = "tarnwell.archive.v1") -> DataFrame:
    """thread, ordinal, round_id, first_turn, last_turn, display, index_text.

    ledger (thread, first_turn, ordinal) keeps the ordinals of rounds that were archived before; new ones go on after
    the thread's largest."""
    rounds = M.rounds(messages, thread, turn)
    if ledger is not None:
        known = ledger.select(thread, "first_turn", F.col("ordinal").alias("_known"))
        top = ledger.groupBy(thread).agg((F.max("ordinal") + 1).alias("_next"))
        both = rounds.join(known, [thread, "first_turn"], "left").join(R.small(top), thread, "left")
        from pyspark.sql import Window as W

        fresh = F.sum(F.col("_known").isNull().cast("int")).over(W.partitionBy(thread).orderBy("ordinal")) - 1
        rounds = both.withColumn("ordinal", F.coalesce("_known", F.coalesce("_next", F.lit(0)) + fresh).cast("int")).drop("_known", "_next")
    keys = key_lines(F.col("display"))
    name = F.concat_ws("|", F.lit(domain), F.col(thread).cast("string"))
    out = rounds.withColumn("round_id", T.chunk_id(name, F.col("ordinal"), F.col("display"))).withColumn("_k", keys)
    return out.withColumn("index_text", F.when(F.col("_k") == "", F.col("display")).otherwise(F.concat("display", F.lit("\n"), "_k"))).drop("_k")


# --- a text index held as a table of (item, text)


def index_upsert(index: DataFrame, new: DataFrame, item: str, order: str | None = None) -> DataFrame:
    """Items with the new ones in place of those with their id; of repeated new ids the last by `order` holds, without an
    order the largest text."""
    text = [c for c in index.columns if c != item]
    one = new.groupBy(item).agg(F.max_by(F.struct(*text), F.struct(*[F.col(c) for c in ([order] if order else []) + text])).alias("_v")).select(item, *[F.col(f"_v.{c}").alias(c) for c in text])
    return index.join(one.select(item), item, "left_anti").unionByName(one.select(*index.columns))


def index_remove(index: DataFrame, ids: DataFrame, item: str) -> DataFrame:
    return index.join(R.small(ids.select(item).distinct()), item, "left_anti").select(*index.columns)


def remove_rounds(indexes: dict[str, DataFrame], ids: DataFrame, item: str, failing: tuple[str, ...] = ()) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every index without the ids, and the removals (index, item) that are still to be done where an index could not
    be written (`failing`); a later call with those ids clears them."""
    after = {name: (df if name in failing else index_remove(df, ids, item)) for name, df in indexes.items()}
    pending = ids.select(F.explode(F.array(*map(F.lit, failing)) if failing else F.array().cast("array<string>")).alias("index"), item).distinct()
    return after, pending


def recalled(hits: DataFrame, rounds: DataFrame, item: str, thread: str, wanted: DataFrame, query: str, limit: int) -> DataFrame:
    """Hits (query, item, rank) whose rounds exist and belong to the query's thread (wanted: query, thread), ranked anew."""
    kept = hits.join(R.small(wanted.select(query, F.col(thread).alias("_t"))), query).join(rounds.select(item, thread), item).filter(F.col(thread) == F.col("_t")).drop("_t")
    return R.ranked(kept.withColumnRenamed("rank", "before"), query, [F.asc("before")], limit)


def orphans(hits: DataFrame, rounds: DataFrame, item: str) -> DataFrame:
    """Indexed items without a round: a sign of an index that was not cleaned."""
    return hits.select(item).distinct().join(rounds.select(item), item, "left_anti")
