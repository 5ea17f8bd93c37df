"""Benchmark decontamination by canonical templates, with DataFrame functions only.

Texts become word sequences in which numbers, units after numbers and names (capitalised words inside a sentence) are
typed placeholders. Windows of `WINDOW` canonical words of the benchmark are hash-joined with all windows of all
documents; an item found at one offset in a document with at least `COVER` of its windows is a candidate. For
candidates the placeholders' values are compared: a re-parameterised copy replaces each value by one other value
throughout, so pairs whose values do not map consistently (`AGREE`) at any offset are dropped. Windows that are mostly
placeholders are not used. Items are also looked up with their names as plain words, as in lower-cased copies; items
that have no other windows are looked up by windows of their words as they stand, in lower
case.

The benchmark's windows are broadcast if there are at most `BROADCAST` of them, as are the candidates' ids; beyond
that both joins shuffle.

Defined cases: null and empty texts match nothing; items of fewer than `WINDOW` words are looked up as one window of
their own length if they have at least `SHORTEST` words, and never match if they have fewer; items with equal text all
match; rows with null ids match nothing; repeated documents match once each doc_id; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm._common import let, materialise, table

NAME = "op6_decontaminate"
WINDOW = 8
SHORTEST = 5
COVER = 0.5
AGREE = 0.9
BROADCAST = 1_000_000
UNITS = "kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches l ml litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent usd eur dollar dollars euro euros cent cents mph kmh w kw v".split()
#: between words: all ASCII but letters, digits and the signs that end sentences, and other punctuation and spaces
BETWEEN = r"[\x00-\x20\x22-\x2D\x2F\x3A-\x3E\x40\x5B-\x60\x7B-\xBF\u2000-\u206F\u3000-\u303F]+"
ENDS = ".!?"


def raw_words(text: Column) -> Column:
    """Words with the signs that end sentences still on them; pieces of such signs alone are no words."""
    return F.filter(F.split(text, BETWEEN), lambda x: F.btrim(x, F.lit(ENDS)) != "")


def words(raw: Column) -> Column:
    return F.transform(raw, lambda x: F.btrim(x, F.lit(ENDS)))


def _number(x: Column) -> Column:
    return F.ascii(x).between(48, 57)


def canonical(raw: Column, out=lambda x: x, names: bool = True) -> Column:
    """out() of each word, numbers, units and, where wanted, names replaced by #n, #u and #name."""

    def one(x: Column, i: Column, all_: Column, marked: Column) -> Column:
        plain = F.when(_number(x), out(F.lit("#n"))).when(x.isin(UNITS) & _number(F.coalesce(F.get(all_, i - 1), F.lit(""))), out(F.lit("#u"))).otherwise(out(x))
        before = F.coalesce(F.get(marked, i - 1), F.lit("."))
        begins = F.substring(before, -1, 1).isin("", *ENDS) | ((x == F.upper(x)) & (F.length(x) > 1))
        return F.when(F.lower(x) == x, plain).when(_number(x), out(F.lit("#n"))).when(begins if names else F.lit(True), out(F.lower(x))).otherwise(out(F.lit("#name")))

    return let(raw, lambda m: let(words(m), lambda w: F.transform(w, lambda x, i: one(x, i, w, m))))


def _hashed(raw: Column) -> Column:
    return canonical(raw, F.xxhash64)


def _windows(tokens: Column, size: int) -> Column:
    """Hashes of all windows of `size` words; null for shorter texts."""

    def all_(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - size + 1, F.lit(1)))
        return F.when(F.size(t) >= size, F.transform(starts, lambda i: F.xxhash64(F.slice(t, i, size))))

    return let(tokens, all_)


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, raw, canon, n, w (the window's length) of usable items."""
    read = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), raw_words(F.col("text")).alias("raw")).distinct()
    read = read.withColumn("canon", canonical(F.col("raw"))).withColumn("n", F.size("raw")).filter(F.col("n") >= SHORTEST)
    read = read.withColumn("w", F.least("n", F.lit(WINDOW)))
    starts = F.sequence(F.lit(1), F.col("n") - F.col("w") + 1)
    return read.withColumn("heavy", ~F.exists(starts, lambda i: _plain(F.slice("canon", i, F.col("w"))) * 2 > F.col("w")))


def _plain(window: Column) -> Column:
    """Words of a canonical window that are no placeholders."""
    return F.size(F.filter(window, lambda t: ~t.startswith("#")))


def _literal(raw: Column) -> Column:
    return F.transform(words(raw), F.lower)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def candidates(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, shift (of the document's words against the item's), hits: windows in common at that shift, of
    the item's `of`."""
    items = materialise(_items(benchmark), "templates")
    raw = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), raw_words(F.col("text")).alias("raw"))
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, shift int, hits long, of long")
    for w, heavy in sorted((r.w, r.heavy) for r in items.select("w", "heavy").distinct().collect()):  # w: SHORTEST to WINDOW
        forms = [_literal(F.col("raw"))] if heavy else [F.col("canon"), canonical(F.col("raw"), names=False)]
        these = items.filter((F.col("w") == w) & (F.col("heavy") == heavy))
        known = None
        for form in forms:
            one = these.select("item_id", "canon", _windows(F.transform(form, lambda t: F.xxhash64(t)), w).alias("ws")).select("item_id", "canon", F.posexplode("ws").alias("ipos", "h"))
            one = (one if heavy else one.filter(_plain(F.slice("canon", F.col("ipos") + 1, F.lit(w))) * 2 > w)).drop("canon")
            known = one if known is None else known.unionByName(one)
        known = materialise(known.distinct(), "template-windows")
        usable = known.groupBy("item_id").agg(F.count_distinct("ipos").alias("of"))
        texts = raw.select("doc_id", (F.transform(_literal(F.col("raw")), lambda t: F.xxhash64(t)) if heavy else _hashed(F.col("raw"))).alias("t"))
        made = texts.select("doc_id", F.posexplode(_windows(F.col("t"), w)).alias("pos", "h"))
        met = made.join(_small(known.join(usable, "item_id")), "h")
        out = out.unionByName(met.groupBy("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"), "of").agg(F.count_distinct("ipos").alias("hits")))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, agree: float = AGREE) -> DataFrame:
    """doc_id, item_id, coverage (share of the item's windows at the best shift whose slots agree), n_slots, agreement
    of the slots."""
    likely = candidates(docs, benchmark).filter(F.col("hits") >= F.col("of") * cover)
    likely = likely.groupBy("doc_id", "item_id", "of").agg(F.collect_set(F.struct("shift", "hits")).alias("at"))
    likely = materialise(likely, "leak-candidates")
    ids = likely.select("doc_id").distinct()
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_small(ids), "doc_id", "left_semi").select("doc_id", words(raw_words(F.col("text"))).alias("doc_raw"))
    items = _items(benchmark).select("item_id", words(F.col("raw")).alias("item_raw"), "canon")
    both = raw.join(likely, "doc_id").join(items, "item_id")

    def slots(shift: Column) -> Column:
        def slot(t: Column, i: Column) -> Column:
            return F.when(t.startswith("#"), F.struct(F.lower(F.get("item_raw", i)).alias("was"), F.lower(F.get("doc_raw", i + shift)).alias("is")))

        return F.array_distinct(F.filter(F.transform("canon", slot), lambda s: s.isNotNull() & s["is"].isNotNull()))

    def judged(x: Column) -> Column:
        def of(s: Column) -> Column:
            values = F.size(F.array_distinct(F.transform(s, lambda y: y["was"])))
            agreement = F.when(F.size(s) == 0, F.lit(1.0)).otherwise(F.round(values / F.size(s), 6))
            return F.struct(F.round(x["hits"] / F.col("of"), 6).alias("coverage"), agreement.alias("agreement"), (-x["shift"]).alias("back"), values.alias("n_slots"))

        return let(slots(x["shift"]), of)

    best = F.array_max(F.filter(F.transform("at", judged), lambda r: r["agreement"] >= agree))
    out = both.select("doc_id", "item_id", best.alias("r")).filter("r is not null")
    return out.groupBy("doc_id", "item_id").agg(F.max("r.coverage").alias("coverage"), F.max("r.n_slots").alias("n_slots"), F.max("r.agreement").alias("agreement"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    found = materialise(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(_small(found), "doc_id", "left_anti").select(*docs.columns)
