"""Text columns: tokens, normal forms, graphemes, byte-safe truncation, content-derived ids."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[^\p{L}\p{M}\p{N}]+"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _normaliser(form: str):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return run


def nfc(c: Column) -> Column:
    """Canonical composition. It runs in Python, so plain text should skip it: below U+0300 it changes nothing."""
    return _normaliser("NFC")(c)


def fold_marks(c: Column) -> Column:
    """Text without combining marks."""
    return F.regexp_replace(_normaliser("NFD")(c), r"\p{M}+", "")


def tokens(c: Column, compose: bool = False, fold: bool = False) -> Column:
    """Lower-cased runs of letters, marks and digits, in order."""
    base = fold_marks(c) if fold else nfc(c) if compose else c
    return F.filter(F.split(F.lower(base), SEPARATORS), lambda x: x != "")


def letter_tokens(c: Column) -> Column:
    """The set of runs of letters and digits, marks aside."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def normalise(c: Column, compose: bool = False) -> Column:
    """Lower case, trimmed, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(nfc(c) if compose else c), r"\s+", " "))


def is_verbatim(span: Column, text: Column) -> Column:
    """Whether a non-empty span stands in the text as it is."""
    return (F.length(span) > 0) & F.contains(text, span)


def graphemes(c: Column) -> Column:
    """Count of user-perceived characters; texts without marks, CR or wide code points take the short way."""
    return F.when(c.rlike(r"[\r\x{300}-\x{36F}\x{2000}-\x{10FFFF}]"), F.size(F.regexp_extract_all(c, F.lit(r"(\X)"), 1))).otherwise(F.length(c))


def token_estimate(c: Column) -> Column:
    """A quarter of the UTF-8 bytes, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(c) / 4)).cast("long")


def truncate_utf8(c: Column, limit: int) -> Column:
    """The longest prefix of whole characters within `limit` bytes."""
    chars = F.split(F.left(c, F.lit(limit)), "")  # a character takes a byte at least
    fits = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars")),
        lambda a, x: F.when(a["bytes"] + F.octet_length(x) <= limit, F.struct((a["bytes"] + F.octet_length(x)).alias("bytes"), (a["chars"] + 1).alias("chars"))).otherwise(F.struct(F.lit(limit + 1).alias("bytes"), a["chars"].alias("chars"))),
    )
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.left(c, fits["chars"]))


def sentences(c: Column) -> Column:
    """Stretches between full stops, exclamation and question marks and line ends, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(c, r"[.!?\n\r\x{85}\x{2028}\x{2029}]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def content_id(*parts: Column) -> Column:
    """32 hex digits of SHA-256 over length-prefixed UTF-8 parts."""
    framed = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p)), 16, "0")), p.cast("binary")) for p in parts]
    return F.substring(F.sha2(F.concat(*framed), 256), 1, 32)


def chunk_id(document: Column, ordinal: Column, content: Column, domain: str = "tarnwell.chunk.v1") -> Column:
    return content_id(F.lit(domain), document, ordinal.cast("string"), content)


def fact_id(thread: Column, subject: Column, predicate: Column, text: Column, domain: str = "tarnwell.fact.v1") -> Column:
    slot = F.concat_ws("|", F.lit(domain), thread, normalise(subject), normalise(predicate))
    return chunk_id(slot, F.lit(0), normalise(text))


def excerpt(c: Column, limit: int) -> Column:
    """The text on one line, cut at `limit` characters with an ellipsis."""
    line = F.regexp_replace(c, "\n", " ")
    return F.when(F.length(line) > limit, F.concat(F.left(line, F.lit(limit)), F.lit("…"))).otherwise(line)


def key_values(pairs: list[tuple[str, Column]]) -> Column:
    """k=v pairs on one line; white space in values becomes an underscore, as does an empty value."""
    shown = [F.concat(F.lit(f"{k}="), F.when(F.coalesce(v.cast("string"), F.lit("")) == "", "_").otherwise(F.regexp_replace(v.cast("string"), r"\s+", "_"))) for k, v in pairs]
    return F.concat_ws(" ", *shown)


def first_line(c: Column, limit: int = 200) -> Column:
    """The first line that is not blank, trimmed and cut; null if there is none. Takes a model's rewritten query."""
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.left(F.get(lines, F.lit(0)), F.lit(limit))
