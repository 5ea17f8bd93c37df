"""Batches of turns made memory: extract, guard, reconcile, apply, archive; and the upkeep of what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.operators import archive as A
from tarnwell.operators import extraction as X
from tarnwell.operators import memory as M
from tarnwell.sources.cuts import written

HELD = 12  # messages of a thread that stay out of the archive


def claims(messages: DataFrame, at: str = "created_at", thread: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Candidates in the columns that reconciliation takes."""
    found = X.candidates(messages, thread, turn).join(messages.select(thread, turn, at), [thread, turn])
    found = found.select("id", F.col(thread).cast("string").alias("thread_id"), "subject", "predicate", "text", "origin", "confidence", "importance", "tags", F.col(at).alias("valid_from"), "retraction")
    return written(found, "claims")  # many rules make a large plan: it ends here


def consolidate(messages: DataFrame, facts: DataFrame, now: Column, at: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """(facts after the batch, decisions). All decisions of a batch read the same snapshot; give one batch at a time."""
    found = claims(messages, at)
    decisions = written(M.reconcile(found, facts, now), "decisions")
    return M.apply_decisions(facts, found, decisions, now), decisions


def reroute(decisions: DataFrame, choice: Column, ambiguous: tuple[str, ...] = ("newerWins", "staleCandidate", "higherConfidenceWins", "higherTrustWins", "slotContradiction")) -> DataFrame:
    """Decisions with the operation that a chooser (a column, as of a pandas UDF) gives for ambiguous ones; a choice
    that is no operation, or has no target where it needs one, changes nothing."""
    valid = F.col("rationale").isin(*ambiguous) & choice.isin("add", "update", "delete", "noop") & (choice.isin("add", "noop") | F.col("target_id").isNotNull())
    fits = F.coalesce(valid, F.lit(False))
    return decisions.withColumn("_c", F.when(fits, choice)).withColumn("rationale", F.when(F.col("_c").isNotNull() & (F.col("_c") != F.col("operation")), "rerouted").otherwise(F.col("rationale"))).withColumn("operation", F.coalesce("_c", "operation")).drop("_c")


def options(found: DataFrame, facts: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """claim, id, rank: the facts a chooser may pick from: similar ones of the thread, then other live ones of the slot."""
    claim = found.select(F.col("id").alias("claim"), "thread_id", "subject", "predicate", "text")
    near = M.similar(facts, claim.select("claim", "thread_id", "text"), now, most).select("claim", "id", "score")
    live = M.with_slot(facts.filter(M.is_live(now))).select(*M.SLOT, "id")
    slot = M.with_slot(claim).join(live, M.SLOT).select("claim", "id", F.lit(0.0).alias("score"))
    best = near.unionByName(slot).groupBy("claim", "id").agg(F.max("score").alias("score"))
    w = W.partitionBy("claim").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("claim", "id", "rank")


def histogram(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("operation", "rationale").agg(F.count("*").alias("n"))


def archivable(messages: DataFrame, held: int = HELD, thread: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The rounds of what is older than a thread's last `held` messages."""
    w = W.partitionBy(thread).orderBy(F.desc(turn))
    old = messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") > held).drop("_n")
    return A.archived_rounds(old, thread=thread, turn=turn)


def maintain(facts: DataFrame, indexes: dict[str, DataFrame], pending: DataFrame, now: Column, item: str = "round_id", **policy) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Pending removals are done in their indexes, then the sweep invalidates what is to be forgotten."""
    after = {name: A.index_remove(df, pending.filter(F.col("index") == name), item) for name, df in indexes.items()}
    gone = M.sweep(facts, now, **policy).select("id")
    return M.invalidate(facts, gone, now), after


def write_costs(log: DataFrame) -> DataFrame:
    """One row of what writing memory cost: log (kind, model_calls, tokens, elapsed_ns)."""
    return log.agg(F.count("*").alias("batches"), F.coalesce(F.sum("model_calls"), F.lit(0)).alias("model_calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("elapsed_ns"), F.lit(0)).alias("elapsed_ns"))
