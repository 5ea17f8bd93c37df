"""SimHash near-duplicate classes over sharded BK-trees.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints within `radius` bits agree on one of
`radius + 1` disjoint blocks of bits, and within the remaining bits on one of `radius + 1` sub-blocks, so every link
lies inside a shard keyed by such a pair of blocks. Each shard's BK-tree is built and searched where the shard lies:
no tree of unbounded size is broadcast. A shard of more than `SHARD` distinct fingerprints is dealt out again by one
more level of blocks; as its members are distinct and differ only in the bits not yet fixed, their number is bounded
by 2 to the power of those bits, so this ends. A shard returns a spanning star of each local class, never all pairs;
classes are joined by alternating large-star and small-star steps.

The pipeline's stage is `keep_dissimilar`: SimHashes of sets of `WIDE`-word shingles, searched by BK-trees in shards of
sets that share first shingles, each link verified by the whole sets' Jaccard similarity; what SimHashes cannot tell is
closed by an exact join of the sets, which only meets pairs across the classes found (`similar`).

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows and equal texts share
a class; rows with a null doc_id get a class too, whose id is the smallest non-null doc_id in reach (null if none);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell.llm._common import binary, discard, materialise, slices, table

NAME = "op9_simhash_dedup"
SHINGLE = 3
RADIUS = 2
SEED = 42
SHARD = 4096
#: of keep_dissimilar: words of a shingle, the similarity as a fraction, bits that SimHashes of linked sets may differ in,
#: frequent shingles held, and sets of a bucket whose pairs are all compared
WIDE = 5
SIMILAR = (4, 5)
NEAR = 11
COMMON = 200_000
FEW = 8
_FULL = (1 << 64) - 1


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text; a bit is set if it is set in over half of the shingles' hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        return digest(join(words), SEED)
    hashes = np.fromiter((digest(join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)))), np.uint64, len(words) - shingle + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row (a hash of the text), fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in binary(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "row", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row(docs)).mapInArrow(run, "doc_id long, row long, fp long")


def _row(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("row")


def split_bits(mask: int, parts: int) -> list[int]:
    """Masks of `parts` disjoint blocks of the bits that `mask` leaves free."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    return [sum(free[len(free) * k // parts : len(free) * (k + 1) // parts]) for k in range(parts)]


def finer(masks: list[int], parts: int) -> list[list[int]]:
    """For each mask those that fix one more block."""
    return [[m | b for b in split_bits(m, parts)] for m in masks]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, x: int, at: int) -> None:
        if self.root is None:
            self.root = [x, at, {}]
            return
        node = self.root
        while True:
            child = node[2].setdefault((x ^ node[0]).bit_count(), [x, at, {}])
            if child[1] == at:
                return
            node = child

    def near(self, x: int, radius: int) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            d = (x ^ node[0]).bit_count()
            if d <= radius:
                yield node[1]
            children = node[2]
            if len(children) <= 2 * radius + 1:
                todo += [c for e, c in children.items() if d - radius <= e <= d + radius]
            else:
                todo += [children[e] for e in range(d - radius, d + radius + 1) if e in children]


def local_stars(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, smallest member) for each class of a shard's distinct fingerprints, without the smallest itself."""
    tree, parent = BKTree(), list(range(len(fps)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    values = fps.tolist()
    for i, v in enumerate(values):
        x = v & _FULL
        for j in tree.near(x, radius):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
        tree.add(x, i)
    return [(values[i], values[r]) for i in range(len(values)) if (r := find(i)) != i]


def _search(radius: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key, large = None, False

        def out(kind: int, t: int, rows: list[tuple[int, int]]) -> pa.RecordBatch:
            a = np.array(rows, np.int64).reshape(-1, 2)
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(a[:, 0]), pa.array(a[:, 1])], names=["kind", "t", "a", "b"])

        for batch in batches:
            t, k, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(fp):
                continue
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(fp)]
            stars: list[tuple[int, int]] = []
            for s, e in zip(bounds, bounds[1:]):
                if (t[s], k[s]) != key:
                    if held and not large and sum(map(len, held)) > 1:
                        stars += local_stars(np.concatenate(held), radius)
                    held, key, large = [], (t[s], k[s]), False
                held.append(fp[s:e])
                if large or sum(map(len, held)) > most:  # too large for one tree: passed on, not held
                    large = True
                    for part in held:
                        yield out(1, int(t[s]), [(x, x) for x in part.tolist()])
                    held = []
            if stars:
                yield out(0, 0, stars)
        if held and not large and sum(map(len, held)) > 1:
            yield out(0, 0, local_stars(np.concatenate(held), radius))

    return run


def links(distinct: DataFrame, radius: int = RADIUS, most: int = SHARD) -> DataFrame:
    """Edges (a, b), a > b as signed longs in the shards' order, that join all fingerprints within the radius."""
    parts = radius + 1
    masks = [m for ms in finer(split_bits(0, parts), parts) for m in ms]
    todo, found = distinct.select("fp", F.lit(-1).alias("t")), None
    table_of: list[list[tuple[int, int]]] = [list(enumerate(masks))]
    while True:
        choices = F.array(*[F.array(*[F.struct(F.lit(i).cast("int").alias("t"), F.lit(_signed(m)).alias("m")) for i, m in group]) for group in table_of])
        which = F.when(F.col("t") < 0, F.lit(0)).otherwise(F.col("t"))
        keyed = todo.select("fp", F.explode(F.element_at(choices, which + 1)).alias("x")).select(F.col("x.t").alias("t"), F.col("x.m").bitwiseAND(F.col("fp")).alias("k"), "fp")
        bound = most if max(64 - bin(m).count("1") for m in masks) > 8 else max(most, 256)
        got = materialise(keyed.repartition(F.col("t"), F.col("k")).sortWithinPartitions("t", "k", "fp").mapInArrow(_search(radius, bound), "kind int, t int, a long, b long"), "simhash-links")
        edges = got.filter("kind = 0").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        over = got.filter("kind = 1")
        if over.isEmpty():
            return found.distinct()
        todo = over.select(F.col("a").alias("fp"), "t")
        groups, count, table_of = finer(masks, parts), 0, []
        for group in groups:
            table_of.append([(count + i, m) for i, m in enumerate(group)])
            count += len(group)
        masks = [m for g in groups for m in g]


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (a, b) with a > b."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = near.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """a, b: every linked node with the smallest of its component, itself left out."""
    now, before = materialise(edges, "simhash-edges"), None
    while True:
        now = materialise(_stars(_stars(now, True), False), "simhash-stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now
        before = state


def rooted(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, fp) of each row of docs, and (fp, root, component_id) of each fingerprint; a class has one root."""
    fps = materialise(fingerprints(docs, shingle), "simhash-fps")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    joined = components(links(distinct, radius))
    member = distinct.join(joined.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    return fps, member.join(lowest, "root").select("fp", "root", "component_id")


def classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for each row of docs."""
    fps, label = rooted(docs, shingle, radius)
    return fps.join(label, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def _first_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of docs for each root of rows (doc_id, row, root)."""
    mark = next(x for x in ("_", *(f"_{i}" for i in range(len(docs.columns) + 1))) if not any(c.lower().startswith(f"{x}key".lower()) for c in docs.columns))
    none, number = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    keys = [f"{mark}key{i}" for i in range(3)]
    first = rows.groupBy("root").agg(F.min(F.struct(none.alias(keys[0]), number.alias(keys[1]), F.col("row").alias(keys[2]))).alias("m")).select("m.*")
    named = docs.withColumns(dict(zip(keys, (none, number, _row(docs)))))
    nth = f"{mark}key3"
    kept = named.join(first, keys, "left_semi").withColumn(nth, F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(0))))
    return kept.filter(F.col(nth) == 1).select(*docs.columns)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each near-duplicate class: its smallest doc_id's, null ones last; of equal ids that with the
    smallest hash of its text, of repeated rows one."""
    fps, label = rooted(docs, shingle, radius)
    return _first_of(docs, fps.join(label, "fp"))


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Distinct shingles' hashes of one text, sorted; a shorter text is one shingle, an empty one has none."""
    words = (text or b"").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    found = {digest(join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)))} if len(words) >= shingle else {digest(join(words), SEED)} if words else set()
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def parities(s: np.ndarray) -> bytes:
    """How often each residue occurs in a set, modulo 2; about as many residues as members, a power of two."""
    bits = max(64, 1 << max(len(s) - 1, 0).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def may_be_similar(n: int, m: int, x: bytes, y: bytes) -> bool:
    """False only if the parities of two sets of n and m members differ in so many places that their similarity is below
    SIMILAR, as each of them is a member that one set alone has."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):  # residues modulo half as many
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    p, q = SIMILAR
    return (n + m - int(np.bitwise_count(a ^ b).sum())) * (p + q) >= (n + m) * 2 * p


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for whole in batches for piece in slices(whole, 4, 1 << 18)):
        keep = [may_be_similar(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _sets(docs: DataFrame, shingle: int, common: np.ndarray | None, whole: bool = False) -> DataFrame:
    """doc_id, row, sid (a hash of the shingle set), n (its size), s: the whole set or, where `common` is given, as many
    of it as two sets of similarity SIMILAR must share one of (all if `whole`); shingles that are not in `common` (sorted)
    come first.
    With these come sig, the set's parities, and fp, its SimHash."""

    def one(text: bytes | None) -> tuple[int, int, np.ndarray, bytes | None, int | None]:
        s = shingle_set(text, shingle)
        n, sid = len(s), xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0
        sig, fp = (parities(s), _signed(majority(s))) if common is not None and not whole else (None, None)
        if common is not None:
            often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(n, bool)
            s = np.concatenate([s[~often], s[often]])[: n if whole else n - -(-n * SIMILAR[0] // SIMILAR[1]) + 1]
        return sid, n, s.view(np.int64), sig, fp

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole, 1)):
            made = [one(t) for t in binary(batch.column(1))]
            ends = np.cumsum([0] + [len(m[2]) for m in made]).astype(np.int32)
            s = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([m[2] for m in made] or [np.zeros(0, np.int64)])))
            sid = pa.array(np.array([m[0] for m in made], np.uint64).view(np.int64))
            sig, fp = pa.array([m[3] for m in made], pa.binary()), pa.array([m[4] for m in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sid, pa.array([m[1] for m in made], pa.int32()), s, sig, fp], names=["doc_id", "row", "sid", "n", "s", "sig", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row(docs)).mapInArrow(run, "doc_id long, row long, sid long, n int, s array<long>, sig binary, fp long")


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """At most COMMON frequent shingles. They only set the order in which shingles are looked up, which any choice of
    them leaves exact, so a hash share of the rows will do."""
    part = docs.filter(F.pmod(_row(docs), F.lit(16)) == 0)
    seen = _sets(part, shingle, None).dropDuplicates(["sid"]).select(F.explode("s").alias("h")).groupBy("h").count().filter("count > 2")
    return np.sort(np.array([r.h for r in seen.orderBy(F.col("count").desc(), "h").limit(COMMON).collect()], np.int64).view(np.uint64))


def _alike(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have similarity SIMILAR."""
    p, q = SIMILAR
    ends = full.join(F.broadcast(pairs.select(F.col("b").alias("sid")).distinct()), "sid", "left_semi") if pairs.select("b").distinct().count() <= COMMON else full
    ends = F.broadcast(ends) if ends.agg(F.coalesce(F.sum(F.size("s")), F.lit(0))).first()[0] <= 1 << 21 else ends
    both = pairs.join(full.select(F.col("sid").alias("a"), F.col("s").alias("s")), "a").join(ends.select(F.col("sid").alias("b"), F.col("s").alias("z")), "b")
    return both.filter(F.size(F.array_intersect("s", "z")) * (p + q) >= (F.size("s") + F.size("z")) * p).select("a", "b")


def _whole(docs: DataFrame, rows: DataFrame, sids: DataFrame, shingle: int, common: np.ndarray | None = None) -> DataFrame:
    """sid, s: the whole sets, made again from one text each; in the order of _sets."""
    named = rows.select("doc_id", "row", "sid").join(sids, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("doc_id", "row")).alias("m")).select("m.doc_id", "m.row")
    named = materialise(named, "set-names")
    count = named.count()
    own, row, number = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row(docs)), F.col("row") == F.col("_row"), F.col("doc_id").eqNullSafe(F.col("_id"))
    other = named.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    texts = own.join(F.broadcast(other) if count <= COMMON else other, row & number, "left_semi")
    made = materialise(_sets(texts, shingle, common, True).select("sid", "s"), "set-full")
    return made if made.count() == count else made.groupBy("sid").agg(F.first("s").alias("s"))  # ids and texts repeat


def _nearest(radius: int, most: int):
    """For rows (c, sid, fp) sorted by c: each set with the nearest of its shard's earlier ones within the radius, (a, b).
    A tree holds `most` fingerprints; then the shard goes on with a new one, whose root is the old one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, fps, sids = None, BKTree(), [], {}
        for batch in batches:
            found: list[tuple[int, int]] = []
            for c, sid, fp in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = fp & _FULL
                if c != key:
                    key, tree, fps, sids = c, BKTree(), [], {}
                elif x in sids:
                    found.append((sid, sids[x]))
                    continue
                elif len(fps) >= most:
                    first = fps[0]
                    tree, fps, sids = BKTree(), [first], {first: sids[first]}
                    tree.add(first, 0)
                near = min((((x ^ fps[at]).bit_count(), at) for at in tree.near(x, radius)), default=None)
                if near:
                    found.append((sid, sids[fps[near[1]]]))
                tree.add(x, len(fps))
                fps.append(x)
                sids[x] = sid
            a = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    return run


def _differences(shards: DataFrame, full: DataFrame) -> DataFrame:
    """c, sid, n, d, k, w, near for rows (c, sid) and the whole sets: k shingles are in either the set or the centre c
    alone, and sets are alike if (p + q) * 2 * (differences in common) >= w + w; near sets are like the centre. d are the
    first of the k, as many as two alike sets must share one of: the set's own, frequent ones last, then the
    centre's. Alike sets differ in no more than n * (q - p) / p shingles, so in no more of their differences."""
    p, q = SIMILAR
    mid = full.join(shards.select(F.col("c").alias("sid")).distinct(), "sid", "left_semi").select(F.col("sid").alias("c"), F.col("s").alias("z"))
    mid = F.broadcast(mid) if mid.agg(F.coalesce(F.sum(F.size("z")), F.lit(0))).first()[0] <= 1 << 21 else mid
    own, other = F.array_except("s", "z"), F.array_except("z", "s")
    made = shards.join(full, "sid").join(mid, "c").select("c", "sid", F.size("s").alias("n"), F.size("z").alias("nc"), F.concat(own, other).alias("d"))
    made = made.withColumn("k", F.size("d")).withColumn("d", F.slice("d", F.lit(1), F.floor(F.col("n") * (q - p) / p).cast("int") + 1))
    return made.select("c", "sid", "n", "d", "k", (F.col("k") * (p + q) - F.col("n") * (q - p)).alias("w"), (F.col("k") * (p + q) <= (F.col("n") + F.col("nc")) * (q - p)).alias("near"))


def _across(at: DataFrame) -> DataFrame:
    """(sid, b): of rows of _differences with a class r, all pairs of one shard and two classes that may be alike. Sets
    like the centre are of its class, so one of a pair is not like it, and such a set is like no other without a
    difference in common. Pairs are met by the first of these, in as many of a set's as leave fewer behind than the least
    that it must share with any other of the shard."""
    p, q = SIMILAR
    at = at.filter("sid <> c")
    least = at.groupBy("c").agg(F.min("w").alias("v"), F.min(F.expr("if(near, null, w)")).alias("v_far"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    at = at.join(least.filter("lo < hi and v_far is not null"), "c")
    share = F.greatest(F.lit(1), F.ceil((F.col("w") + F.when(F.col("near"), F.col("v_far")).otherwise(F.col("v"))) / (2 * (p + q))))
    each = at.select("c", "sid", "n", "k", "w", "near", "r", share.alias("t"), F.posexplode("d").alias("i", "e")).filter("i <= k - t").drop("t")
    here = W.partitionBy("c", "e")
    each = each.withColumns({"lo": F.min("r").over(here), "hi": F.max("r").over(here)}).filter("lo < hi").drop("lo", "hi")
    each = materialise(each, "set-differences")
    other = each.select("c", "e", *[F.col(x).alias(y) for x, y in {"sid": "b", "n": "m", "k": "l", "w": "u", "near": "close", "r": "z", "i": "j"}.items()])
    sizes = (F.least("n", "m") * q) >= (F.greatest("n", "m") * p)
    behind = F.least(F.col("k") - F.col("i"), F.col("l") - F.col("j")) * (2 * (p + q)) >= F.col("w") + F.col("u")
    return each.filter("not near").join(other, ["c", "e"]).filter("r <> z and (close or sid > b)").filter(sizes & behind).select("sid", "b")


def _cells(at: DataFrame) -> DataFrame:
    """h, g, sid, n, i, r, few: the rows (h, sid, n, i, r) of each bucket h in cells g that hold sets of two classes. A
    size's band is its logarithm by a little more than the ratio that two alike sets' sizes can have, so theirs are the
    same or neighbours; a cell holds two neighbouring bands, the lower of which is not empty."""
    p, q = SIMILAR
    cell, band = W.partitionBy("h", "g"), F.floor(F.log("n") / math.log(1.01 * q / p)).cast("int")
    each = at.select("*", band.alias("k")).withColumn("g", F.explode(F.array(F.col("k") - 1, "k")))
    each = each.withColumns({"few": F.count("*").over(cell) <= FEW, "low": F.min("k").over(cell), "lo": F.min("r").over(cell), "hi": F.max("r").over(cell)})
    return each.filter("low = g and lo < hi").select("h", "g", "sid", "n", "i", "r", "few")


def similar(docs: DataFrame, shingle: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, sid) of each row of docs, and (sid, root): sets of Jaccard similarity SIMILAR or more, and chains
    of them, have one root. Exact: two such sets share one of their first shingles in any common order, and what they
    share beyond those that both have first lies in the rest of one of them.

    A bucket holds the sets with one first shingle, a shard all buckets with one smallest set. BK-trees of the shards'
    SimHashes give each set its nearest one; what of that is alike makes classes. Then buckets of up to FEW sets give all
    their pairs across classes. Larger ones are split into cells of sets of like size, and those of up to FEW give all
    theirs. As larger cells come from copies of one text, their sets are compared with a centre, the set of the cell's
    largest class with the fewest rare shingles, and beyond that only with those of other classes that differ from the
    centre alike."""
    p, q = SIMILAR
    common = _common(docs, shingle)
    rows = materialise(_sets(docs, shingle, common), "set-prefixes")
    sets = rows.groupBy("sid", "n").agg(F.first("s").alias("s"))
    bucket = W.partitionBy("h")
    met = sets.select("sid", "n", F.posexplode("s").alias("i", "h")).withColumns({"few": F.count("*").over(bucket), "c": F.min("sid").over(bucket)}).filter("few > 1").withColumn("few", F.col("few") <= FEW)
    met = materialise(met.select("h", "sid", "n", "i", "few", "c"), "set-buckets")
    sigs = materialise(rows.join(met.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("fp").alias("fp")), "set-sigs")
    sizes = (F.least("n", "m") * q) >= (F.greatest("n", "m") * p)
    # the first shingle in common is i-th in one and j-th in the other, and all others lie behind it
    behind = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) * (p + q) >= (F.col("n") + F.col("m")) * p

    def verified(pairs: DataFrame) -> DataFrame:
        some = pairs.toDF("x", "y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        some = some.join(sigs.select(F.col("sid").alias("a"), "n", F.col("sig").alias("x")), "a").join(sigs.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("sig").alias("y")), "b")
        some = materialise(some.filter(sizes).select("a", "b", "n", "m", "x", "y").mapInArrow(_likely, "a long, b long"), "set-pairs")
        full = _whole(docs, rows, some.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), shingle)
        got = materialise(_alike(some, full), "set-edges")
        discard(some)
        return got

    def classed(at: DataFrame, edges: DataFrame) -> DataFrame:
        root = components(edges).select(F.col("a").alias("sid"), F.col("b").alias("r"))
        return at.join(root, "sid", "left").withColumn("r", F.coalesce("r", "sid"))

    shards = met.select("c", "sid").distinct().join(sigs.select("sid", "fp"), "sid").select("c", "sid", "fp")
    edges = verified(shards.repartition("c").sortWithinPartitions("c", "sid").mapInArrow(_nearest(NEAR, SHARD), "a long, b long"))
    known = classed(met, edges)
    split = known.groupBy("h").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).filter("lo < hi").select("h")
    at = materialise(known.join(split, "h"), "set-split")
    cells = materialise(_cells(at.filter("not few").select("h", "sid", "n", "i", "r")), "set-cells")
    few = at.filter("few").select("h", F.lit(None).cast("int").alias("g"), "sid", "n", "i", "r").unionByName(cells.filter("few").drop("few"))
    other = few.select("h", "g", *[F.col(k).alias(v) for k, v in {"sid": "b", "n": "m", "i": "j", "r": "z"}.items()])
    met_here = (few["h"] == other["h"]) & few["g"].eqNullSafe(other["g"])
    edges = edges.unionByName(verified(few.join(other, met_here).filter("r <> z and sid > b").filter(sizes & behind).select("sid", "b")))
    large = cells.filter("not few")
    by_class = large.groupBy("h", "g", "r").agg(F.count("*").alias("most"), F.min(F.struct(F.col("i") / F.col("n"), "sid")).alias("x"))
    centre = by_class.groupBy("h", "g").agg(F.max(F.struct("most", "r", F.col("x.sid").alias("c"))).alias("x")).select("h", "g", "x.c")
    many = large.join(centre, ["h", "g"]).select("c", "sid").distinct()
    if not many.isEmpty():
        full = _whole(docs, rows, many.select("sid").distinct(), shingle, common)
        far = materialise(_differences(many, full), "set-centres")
        edges = edges.unionByName(far.filter("near and sid <> c").select(F.greatest("sid", "c").alias("a"), F.least("sid", "c").alias("b")))
        edges = edges.unionByName(verified(_across(classed(far, edges))))
    label = components(edges).select(F.col("a").alias("sid"), F.col("b").alias("root"))
    discard(met, sigs, at, cells)
    return rows.select("doc_id", "row", "sid"), label


def keep_dissimilar(docs: DataFrame, shingle: int = WIDE) -> DataFrame:
    """As keep_one, for classes of texts whose word shingles have Jaccard similarity SIMILAR or more."""
    rows, label = similar(docs, shingle)
    return _first_of(docs, rows.join(label, "sid", "left").select("doc_id", "row", F.coalesce("root", "sid").alias("root")))
