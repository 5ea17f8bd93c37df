"""Ordered pattern redaction; texts over the limit are replaced whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwell.functions.checks import LIMIT, SECRETS
from tarnwell.functions.text import let

#: fixed values: name, pattern, replacement
COMMON = [
    ("email", r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,253}\.[A-Za-z]{2,24}", "⟨email⟩"),
    ("us-phone", r"\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}", "⟨phone⟩"),
    ("bearer-token", r"(?i)bearer\s{1,8}[A-Za-z0-9._\-]{16,512}", "Bearer ⟨token⟩"),
    ("aws-access-key", r"AKIA[0-9A-Z]{16}", "⟨aws-key⟩"),
]
FROM_SECRETS = [(f"secret-{i}", p, "⟨secret⟩") for i, p in SECRETS]


def redact_one(c: Column, pattern: str, replacement: str, limit: int = LIMIT) -> Column:
    return F.when(F.octet_length(c) > limit, F.lit(f"⟨redacted: input exceeded {limit}-byte scan limit⟩")).otherwise(F.regexp_replace(c, pattern, replacement))


def redact(c: Column, rules=COMMON, limit: int = LIMIT) -> Column:
    def step(text: Column, rest) -> Column:
        if not rest:
            return text
        _, pattern, replacement = rest[0]
        return step(let(text, lambda t: redact_one(t, pattern, replacement, limit)), rest[1:])

    return step(c, list(rules))


def redact_with_names(c: Column, rules=COMMON, limit: int = LIMIT) -> Column:
    """(text, applied): the text after all rules and the names of those that changed it, each step computed once."""
    state = F.struct(c.alias("text"), F.array().cast("array<string>").alias("applied"))

    def after(s: Column, rule) -> Column:
        name, pattern, replacement = rule
        names = lambda new: F.when(new != s["text"], F.concat(s["applied"], F.array(F.lit(name)))).otherwise(s["applied"])
        return let(redact_one(s["text"], pattern, replacement, limit), lambda new: F.struct(new.alias("text"), names(new).alias("applied")))

    def step(s: Column, rule) -> Column:
        return let(s, lambda x: after(x, rule))

    for rule in rules:
        state = step(state, rule)
    return state
