"""Verdicts: pass, repair, reject or escalate, with a diagnostic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwell.functions.text import let

TYPE = "struct<type:string,diagnostic:struct<verifier:string,message:string,suggestion:string>>"
COST = {"parse": 0, "schema": 10, "types": 20, "lint": 30, "unitTest": 40, "integrationTest": 50, "proof": 60, "human": 70}


def passed() -> Column:
    return F.struct(F.lit("pass").alias("type"), F.lit(None).cast("struct<verifier:string,message:string,suggestion:string>").alias("diagnostic"))


def failed(kind: str, verifier: str, message: Column | str, suggestion: str | None = None) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(kind).alias("type"), F.struct(F.lit(verifier).alias("verifier"), message.alias("message"), F.lit(suggestion).cast("string").alias("suggestion")).alias("diagnostic"))


def check(holds: Column, verifier: str, message: Column | str, kind: str = "repair") -> Column:
    """A passing verdict where `holds` is true; a null is a failure."""
    return F.when(F.coalesce(holds, F.lit(False)), passed()).otherwise(failed(kind, verifier, message))


def _by_cost(members: list[tuple[int, str, Column]]) -> list[tuple[int, str, Column]]:
    return sorted(members, key=lambda m: (m[0], m[1]))


def first_failure(members: list[tuple[int, str, Column]]) -> Column:
    """Members (cost, name, verdict), cheapest first; dear ones are not evaluated after a failure."""
    out = passed()
    for _, _, verdict in reversed(_by_cost(members)):
        out = _or_next(verdict, out)
    return out


def _or_next(verdict: Column, after: Column) -> Column:
    return let(verdict, lambda v: F.when(v["type"] != "pass", v).otherwise(after))


def all_failures(members: list[tuple[int, str, Column]], cap: int = 8) -> Column:
    """A reject or escalate wins alone, the earliest of them; otherwise up to `cap` repairs are put together."""

    def judged(verdicts: Column) -> Column:
        hard = F.filter(verdicts, lambda v: v["type"].isin("reject", "escalate"))
        soft = F.slice(F.filter(verdicts, lambda v: v["type"] == "repair"), 1, cap)
        joined = F.array_join(F.transform(soft, lambda v: v["diagnostic"]["message"]), "; ")
        return F.when(F.size(hard) > 0, F.element_at(hard, 1)).when(F.size(soft) == 1, F.element_at(soft, 1)).when(F.size(soft) > 1, failed("repair", "chain", joined)).otherwise(passed())

    return let(F.array(*[v for _, _, v in _by_cost(members)]), judged)
