"""Retrieval metrics, rank stability, pass rates, gates, memory grades, sampling scores and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.functions import text as T


def top_k(results: DataFrame, case: str, item: str, rank: str, k: int) -> DataFrame:
    """The first k distinct items, each at its first place, numbered anew."""
    first = results.groupBy(case, item).agg(F.min(rank).alias("_r"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy(case).orderBy("_r"))).filter(F.col("rank") <= k).select(case, item, "rank")


def equal_ideal(relevant: Column, k: int) -> Column:
    """The ideal DCG where so many items gain 1 each."""
    return F.aggregate(F.sequence(F.lit(1), F.least(relevant, F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))


def retrieval_metrics(results: DataFrame, gains: DataFrame, cases: DataFrame, k: int, case: str = "case_id", item: str = "item_id", ideal: DataFrame | None = None) -> DataFrame:
    """case, retrieved, recall, precision, reciprocal_rank, ndcg; undefined ones are null.

    results (case, item, rank), gains (case, item, gain). Precision divides by what was returned, not by k; gains are
    linear and the ideal order takes all gains of the case. Where ideal (case, relevant, idcg) is given, gains need hold
    the results' items only."""
    top = top_k(results, case, item, "rank", k)
    hit = top.join(gains.select(case, item, "gain"), [case, item], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    got = hit.groupBy(case).agg(
        F.count("*").alias("retrieved"),
        F.count_if(F.col("gain") > 0).alias("hits"),
        F.min(F.when(F.col("gain") > 0, F.col("rank"))).alias("first"),
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    if ideal is None:
        placed = gains.filter("gain > 0").withColumn("_n", F.row_number().over(W.partitionBy(case).orderBy(F.desc("gain"), item)))
        ideal = placed.groupBy(case).agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("_n") <= k, F.col("gain") / F.log2(F.col("_n") + 1))).alias("idcg"))
    all_ = cases.select(case).distinct().join(got, case, "left").join(ideal, case, "left")
    n = F.coalesce("retrieved", F.lit(0))
    return all_.select(
        case,
        n.cast("long").alias("retrieved"),
        F.round(F.when(F.col("relevant") > 0, F.coalesce("hits", F.lit(0)) / F.col("relevant")), 9).alias("recall"),
        F.round(F.when(n > 0, F.col("hits") / n), 9).alias("precision"),
        F.round(F.when(F.col("relevant") > 0, F.coalesce(1 / F.col("first"), F.lit(0.0))), 9).alias("reciprocal_rank"),
        F.round(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")), 9).alias("ndcg"),
    )


def mean_metrics(metrics: DataFrame, *by: str) -> DataFrame:
    """Means that skip undefined values, over all or by columns."""
    names = ["recall", "precision", "reciprocal_rank", "ndcg"]
    return metrics.groupBy(*by).agg(F.count("*").alias("cases"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in names])


def rank_stability(base: DataFrame, other: DataFrame, case: str, item: str) -> DataFrame:
    """case, shared, overlap (share of the base list that the other has), top_kept, max_shift and Kendall's tau over the
    shared items; what is undefined is null. Give both lists cut at the same k."""
    b, o = base.select(case, item, F.col("rank").alias("b")), other.select(case, item, F.col("rank").alias("o"))
    both = b.join(o, [case, item], "full_outer")
    pairs = both.filter("b is not null and o is not null").select(case, F.struct("b", "o").alias("p"))
    lists = pairs.groupBy(case).agg(F.array_sort(F.collect_list("p")).alias("ps"))  # a result list is short

    def after(p: Column, i: Column) -> Column:
        return F.aggregate(F.slice("ps", i + 2, F.greatest(F.size("ps"), F.lit(1))), F.lit(0), lambda a, q: a + F.signum(q["o"] - p["o"]).cast("int"))

    tau = F.aggregate(F.transform("ps", after), F.lit(0), lambda a, x: a + x)
    stats = both.groupBy(case).agg(
        F.count("b").alias("based"), F.count_if(F.col("b").isNotNull() & F.col("o").isNotNull()).alias("shared"),
        F.max(F.abs(F.col("b") - F.col("o"))).alias("max_shift"), F.max((F.col("b") == 1) & (F.col("o") == 1)).alias("top_kept"),
    )
    n = F.size("ps")
    return stats.join(lists, case, "left").select(case, "shared", F.round(F.when(F.col("based") > 0, F.col("shared") / F.col("based")), 9).alias("overlap"), F.coalesce("top_kept", F.lit(False)).alias("top_kept"), "max_shift", F.round(F.when(n >= 2, tau * 2.0 / (n * (n - 1))), 9).alias("tau"))


def abstentions(results: DataFrame, cases: DataFrame, case: str, score: str, floor: float) -> DataFrame:
    """case, retrieved, top_score, abstained: nothing found, or nothing at the floor or over."""
    got = results.groupBy(case).agg(F.count("*").alias("retrieved"), F.max(score).alias("top_score"))
    out = cases.select(case).distinct().join(got, case, "left")
    return out.select(case, F.coalesce("retrieved", F.lit(0)).alias("retrieved"), "top_score", F.coalesce(F.col("top_score") < floor, F.lit(True)).alias("abstained"))


def pass_rate(outcomes: DataFrame, *by: str) -> DataFrame:
    """outcomes (case_id, kind, passed): a case passes if it completed and all its checks passed."""
    ok = ((F.col("kind") == "completed") & F.col("passed")).cast("int")
    return outcomes.groupBy(*by).agg(F.count("*").alias("cases"), F.sum(ok).alias("passed"), F.round(F.avg(ok), 9).alias("pass_rate"))


def gate(candidate: DataFrame, baseline: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """One row: both pass rates, regressions (passed before, not now), and whether the gate opens: the rate reaches the
    threshold and lies at most the tolerance below the baseline's. Regressions are told, they do not close it."""
    both = candidate.select("case_id", F.col("passed").alias("c")).join(baseline.select("case_id", F.col("passed").alias("b")), "case_id", "full_outer")
    got = both.agg(
        F.round(F.avg(F.col("c").cast("int")), 9).alias("pass_rate"), F.round(F.avg(F.col("b").cast("int")), 9).alias("baseline_rate"),
        F.count_if(F.col("b") & ~F.col("c")).alias("regressions"),
    )
    return got.withColumn("gate_open", (F.col("pass_rate") >= threshold) & (F.col("pass_rate") >= F.col("baseline_rate") - tolerance))


def memory_grade(texts: Column, must: Column, must_not: Column) -> Column:
    """missing and forbidden terms of an ordered array of recalled texts."""
    blob = T.normalise(F.array_join(F.array_distinct(texts), "\n"))
    has = lambda t: F.contains(blob, T.normalise(t))
    missing, forbidden = F.array_sort(F.filter(must, lambda t: ~has(t))), F.array_sort(F.filter(must_not, lambda t: has(t)))
    return F.struct(missing.alias("missing"), forbidden.alias("forbidden"), ((F.size(missing) == 0) & (F.size(forbidden) == 0)).alias("passed"))


def best_of_n(checks: DataFrame, run: str = "run_id", candidate: str = "candidate", first_pass: bool = False) -> DataFrame:
    """run, candidate, score, chosen from checks (run, candidate, weight, verdict): earned over total weight, 1 without
    checks; a reject or escalate disqualifies; the best, then earliest, is chosen, the first if all are out. With
    first_pass the earliest that passes every check comes before any other."""
    got = checks.groupBy(run, candidate).agg(
        F.sum(F.when(F.col("verdict") == "pass", F.col("weight")).otherwise(0.0)).alias("earned"), F.sum("weight").alias("total"),
        F.max(F.col("verdict").isin("reject", "escalate")).alias("out"), F.min(F.col("verdict") == "pass").alias("all_pass"),
    )
    got = got.withColumn("score", F.round(F.when(F.coalesce("total", F.lit(0.0)) == 0, 1.0).otherwise(F.col("earned") / F.col("total")), 9))
    order = W.partitionBy(run).orderBy(F.col("out").asc(), *([F.col("all_pass").desc(), F.when(F.col("all_pass"), F.col(candidate)).asc_nulls_last()] if first_pass else []), F.when(F.col("out"), 0.0).otherwise(F.col("score")).desc(), candidate)
    return got.withColumn("chosen", F.row_number().over(order) == 1).select(run, candidate, "score", F.col("out").alias("disqualified"), "chosen")


def agreement(texts: DataFrame, group: str, text: str) -> DataFrame:
    """group, n, agreement: mean Jaccard of token sets over pairs; two empty texts agree, fewer than two texts are null.

    A token's share is counted once for each pair that has it, so only the group's own array is compared."""
    sets = texts.groupBy(group).agg(F.collect_list(T.letter_tokens(F.col(text))).alias("s"))  # a run's candidates are few
    n = F.size("s")

    def jaccard(a: Column, b: Column) -> Column:
        union = F.size(F.array_union(a, b))
        return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)

    rest = lambda a, i: F.aggregate(F.slice("s", i + 2, F.greatest(n, F.lit(1))), F.lit(0.0), lambda t, b: t + jaccard(a, b))
    total = F.aggregate(F.transform("s", rest), F.lit(0.0), lambda t, x: t + x)
    return sets.select(group, n.alias("n"), F.round(F.when(n >= 2, total * 2 / (n * (n - 1))), 6).alias("agreement"))
