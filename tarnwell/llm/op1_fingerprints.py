"""Weighted SimHash fingerprints and their permuted block tables, with DataFrame functions only.

A text's terms are its pairs of neighbouring words, lower-cased (the last word stands alone too), weighted by their
length up to `MOST`, as long pairs are rare ones. Every term's 64-bit hash votes with its weight on each bit. The 64
counts are summed in 32 longs of two counters each, so terms are hashed, exploded and summed in one generated stage.

The next document in descending doc_id comes from a window inside ranges of doc_id that are cut at quantiles; the
first rows of a range are also given to the range before it, so no window holds more than a range and texts are
shuffled once. `near_pairs` finds all pairs of fingerprints within a Hamming radius by tables keyed by permuted blocks
of bits, and the query tells each document's class of equal fingerprints and its number of links.

Defined cases: null and empty texts have fingerprint zero and count as empty; rows with a null doc_id come after all
others, rows that repeat a doc_id in order of text; a single row is followed by itself; an empty table gives an empty
result; other columns are ignored. Empty texts are one class; a class of rows without doc_id has no class_id.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.llm._common import let, materialise, table

NAME = "op1_fingerprints"
MOST = 16
RANGES = 4  # for each shuffle partition
RADIUS = 3
BLOCKS = 6
HOT = 256
SALTS = 8


def terms(text: Column) -> Column:
    """Array of (h, wt)."""

    def pairs(w: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            y = F.coalesce(F.get(w, i + 1), F.lit(""))
            return F.struct(F.xxhash64(x, y).alias("h"), F.least(F.length(x) + F.length(y), F.lit(MOST)).cast("long").alias("wt"))

        return F.transform(w, one)

    return let(F.split(F.lower(text), r"[\x09-\x0D\x20]+"), pairs)


def _votes() -> list[Column]:
    pair = F.lit((1 << 32) + 1)
    return [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(pair) * F.col("wt")).alias(f"v{j}") for j in range(32)] + [F.sum("wt").alias("of")]


def _bits() -> Column:
    """The fingerprint from v0 to v31 and of."""
    out = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(F.col(f"v{j}"), 32)
        for at, count in ((j, low), (j + 32, high)):
            out = out.bitwiseOR(F.when(count * 2 > F.col("of"), F.lit((1 << at) - (1 << 64) if at == 63 else 1 << at)).otherwise(F.lit(0)).cast("long"))
    return out


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and fp, a signed long, for each row of df; the keys tell rows apart."""
    return df.select(*keys, F.inline(terms(F.coalesce(F.col(text), F.lit(""))))).groupBy(*keys).agg(*_votes()).select(*keys, _bits().alias("fp"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_tables(bits: list[int], radius: int, blocks: int) -> list[int]:
    """Masks over the given bits, cut into blocks: values within the radius on these bits agree under one of them."""
    cuts = [len(bits) * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << b for b in bits[cuts[k] : cuts[k + 1]]) for k in range(blocks)]
    return [sum(parts[k] for k in c) for c in combinations(range(blocks), blocks - radius)]


def _first(apart: Column, masks: list[int]) -> Column:
    """Number of the first table under which two values agree; null if none."""
    return F.coalesce(*[F.when(apart.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(t)) for t, m in enumerate(masks)])


def near_pairs(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """a < b, distance: all pairs of the distinct values of fps.fp within the radius.

    Two values within the radius agree on `blocks` - `radius` of the blocks: one table is keyed by each such choice.
    Values alone under a key leave at once; a key of more than `hot` values is dealt out again by tables of the bits that
    it does not fix. A pair is given by the first table, and there the first inner one, that holds it, so none comes twice."""
    tables = block_tables(list(range(64)), radius, blocks)
    inner = [block_tables([b for b in range(64) if not m >> b & 1], radius, blocks) for m in tables]
    one = fps.select("fp").filter("fp is not null").distinct().select("fp", F.posexplode(F.array(*[F.lit(_signed(m)) for m in tables])).alias("t", "m"))
    one = one.select("t", F.col("m").bitwiseAND(F.col("fp")).alias("k"), "fp")
    met = materialise(one.withColumn("n", F.count("*").over(W.partitionBy("t", "k"))).filter("n > 1"), "block-tables")
    deal = F.element_at(F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for ms in inner]), F.col("t") + 1)
    cool = met.filter(F.col("n") <= hot).select("t", "k", F.lit(-1).alias("t2"), F.lit(0).cast("long").alias("k2"), "fp")
    dealt = met.filter(F.col("n") > hot).select("t", "k", "fp", F.posexplode(deal).alias("t2", "m")).select("t", "k", "t2", F.col("m").bitwiseAND(F.col("fp")).alias("k2"), "fp")
    keyed = cool.unionByName(dealt)
    keys = ["t", "k", "t2", "k2"]
    both = keyed.withColumnRenamed("fp", "a").join(keyed.withColumnRenamed("fp", "b"), keys).filter("a < b").withColumn("apart", F.col("a").bitwiseXOR(F.col("b")))
    both = both.withColumn("distance", F.bit_count("apart")).filter((F.col("distance") <= radius) & (F.col("t") == _first(F.col("apart"), tables)))
    again = F.coalesce(*[F.when(F.col("t") == t, _first(F.col("apart"), ms)) for t, ms in enumerate(inner)])
    return both.filter((F.col("t2") < 0) | (F.col("t2") == again)).select("a", "b", "distance")


def linked(rows: DataFrame) -> DataFrame:
    """rows (doc_id, edited_sha256, fp, ...) with class_id, the smallest doc_id with that fingerprint, and n_near, the number of other
    rows whose fingerprint lies within the radius, equal ones included. Pairs are between fingerprints, never between
    copies; what is known of a fingerprint meets its rows in `SALTS` parts."""
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "classes")
    pairs = near_pairs(classes)
    ends = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("fp"), F.col("b").alias("other")), F.struct(F.col("b").alias("fp"), F.col("a").alias("other")))))
    links = ends.join(classes.select(F.col("fp").alias("other"), "n"), "other").groupBy("fp").agg(F.sum("n").alias("around"))
    of = classes.join(links, "fp", "left").withColumn("n_near", F.col("n") - 1 + F.coalesce("around", F.lit(0))).filter("n_near > 0")
    of = of.select("fp", "class_id", "n_near", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    met = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "edited_sha256"), F.lit(SALTS)).cast("int")).join(of, ["fp", "salt"], "left").drop("salt")
    return met.withColumn("class_id", F.coalesce("class_id", "doc_id")).withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))


def edited(docs: DataFrame) -> DataFrame:
    """range, spot (rows of a range in descending doc_id), ghost (a row given to the range before), doc_id, n_chars,
    edited_sha256, text, edited for each row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id").filter("doc_id is not null")
    n = min(4000, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n)))
    place = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]).cast("array<long>"), lambda c: c <= F.col("doc_id"))) + 1
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(place))
    tops = rows.select("range", "doc_id").groupBy("range").agg(F.max("doc_id").alias("top")).orderBy("range").collect()  # one row a range
    goes = [(t.top, tops[(k + 1) % len(tops)].range) for k, t in enumerate(tops)]
    known = {top: to for top, to in goes if top is not None}
    after = F.when(F.col("doc_id").isNull(), F.lit(next((to for top, to in goes if top is None), None)).cast("int"))
    if known:
        after = after.when(F.col("doc_id").isin(list(known)), F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.col("doc_id")))
    own = F.struct(F.col("range").cast("int").alias("range"), F.lit(False).alias("ghost"))
    both = F.when(after.isNotNull(), F.array(own, F.struct(after.cast("int").alias("range"), F.lit(True).alias("ghost")))).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", F.inline(both))
    w = W.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    dealt = dealt.withColumn("next", F.lead("text").over(w)).withColumn("spot", F.row_number().over(w))
    size = F.length("text")
    text = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("substring(coalesce(next, ''), 1, cast(floor(length(text) / 3) as int))"))
    out = dealt.select("range", "spot", "ghost", "doc_id", size.cast("long").alias("n_chars"), "text", text.alias("edited"))
    return out.withColumn("edited_sha256", F.sha2("edited", 256))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp."""
    keys = ["range", "spot", "ghost", "doc_id", "n_chars", "edited_sha256"]
    both = edited(docs).select(*keys, F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))))
    both = both.filter("not ghost or kind = 0")
    fps = fingerprints(both, [*keys, "kind"], "t")
    one = fps.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    one = one.withColumn("next_fp", F.lead("fp").over(W.partitionBy("range").orderBy("spot")))
    return one.filter("not ghost").select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def likeness(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linked(materialise(compared(table(spark, sf_dir, "documents")), "compared"))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return got.select("doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "class_id", "n_near")
