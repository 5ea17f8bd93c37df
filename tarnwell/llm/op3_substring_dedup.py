"""Exact removal of word passages that an earlier document has, by level-wise doubling of window lengths.

Texts that equal an earlier one lose everything and are set aside first. The others are laid out once by doc_id; all
later joins with them move hashes, not texts. Level one looks at windows of `SHORT` words, thinned without loss: only
those with the smallest hash in some `WINDOW`-word window are kept. Equal long windows have equal smallest short ones,
kept in each of their documents, whatever stands around them. Short windows found in one document alone are dropped;
long windows (twice as long, and the odd word) are made only where their smallest short window survives. A window is
known by its short window's hash and its own, 128 bits. One that starts in a document with a smaller doc_id covers
words that go. `repeats` carries the doubling on (26, 52, ... words) until no candidate survives, and returns the
longest passages.

Both levels compare what lies in one Arrow batch on the spot and send one row for each window and batch to the shuffle,
however many documents of the batch have it. Shuffled rows are sorted and streamed past their group's first one, so no
group is held.

Defined cases: null and empty texts have no words; rows with a null doc_id lose nothing and take nothing from others;
rows that repeat a doc_id do not shadow each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm._common import binary, chunks, discard, laid_out, materialise, table

NAME = "op3_substring_dedup"
WINDOW = 13
SHORT = 6
CHUNK = 1 << 20  # bytes of text hashed at once
BROADCAST = 1_000_000  # hashes of texts

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_MULS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MULS[2]
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of some texts."""
    joined = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
    sizes = ends - starts
    letters = joined[~space]
    first = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.full(int(sizes.max()), _MULS[0]), dtype=np.uint64)
    spot = np.arange(len(letters)) - np.repeat(first, sizes)
    return _mix(np.add.reduceat(_TABLE[letters] * powers[spot], first)), np.searchsorted(begin, starts, "right") - 1


def gram_hashes(words: np.ndarray, size: int, mul: np.uint64) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, size):
        out = out * mul + words[j : j + n]
    return _mix(out)


def slide(x: np.ndarray, width: int, of: Callable) -> np.ndarray:
    """of() over each run of `width` values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = of(x[: len(x) - step], x[step:])
        have += step
    return x


def kept_shorts(words: np.ndarray, doc: np.ndarray, window: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the short window at each place, whether it is kept there, and the smallest one of each long window."""
    g = gram_hashes(words, short, _MULS[1])
    span = window - short + 1
    if len(words) < window:
        return g, np.zeros(len(g), bool), np.zeros(0, np.uint64)
    low = slide(g, span, np.minimum)
    low = np.where(doc[: len(low)] == doc[window - 1 :], low, np.uint64(0))  # windows lie in one document
    pad = np.zeros(span - 1, np.uint64)
    high = slide(np.concatenate([pad, low, pad]), span, np.maximum)
    return g, (g == high) & (high > 0), low


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"), F.xxhash64(F.lit(1), "text").alias("row2"))


def _small(df: DataFrame, rows: int = BROADCAST) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def copies(docs: DataFrame) -> DataFrame:
    """row, row2 (hashes of a text) and low: texts of two documents or more, with the smallest doc_id."""
    named = _plain(docs).filter("doc_id is not null and text is not null")
    return materialise(_shared(named.select("doc_id", "row", "row2"), "row", "row2"), "copies")


def laid(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """doc_id, slot (doc_id, or a hash of the text where it is null), row, text, copy, fresh (texts at their smallest
    doc_id), laid out by slot."""
    copy = F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False))
    fresh = F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~copy
    rows = _plain(docs).join(_small(copied), ["row", "row2"], "left")
    return laid_out(rows.select("doc_id", F.coalesce("doc_id", "row").alias("slot"), "row", "text", copy.alias("copy"), fresh.alias("fresh")), "slot", "passages")


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys found in two documents or more, with the smallest doc_id."""
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select(*keys, "low")


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts, hashes of their words and the words' text numbers in the range."""
    for a, b in chunks(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), CHUNK):
        yield a, b, *word_hashes([t or b"" for t in binary(texts.slice(a, b - a))])


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Whether each of some rows, sorted by keys, begins a group."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _shorts(texts: DataFrame, window: int, short: int) -> DataFrame:
    """h, doc_id, known: the kept short windows of each document. Those that two documents of a batch have are given once
    for each of them as known and once for the batch as not known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, made = batch.column(0).to_numpy(zero_copy_only=False), []
            for a, b, words, doc in _parts(batch.column(1)):
                g, keep, _ = kept_shorts(words, doc, window, short)
                made.append((g[keep].view(np.int64), ids[a:b][doc[: len(g)][keep]]))
            if not made:
                continue
            h, d = (np.concatenate(x) for x in zip(*made))
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            one = _begins(h, d)
            h, d = h[one], d[one]
            new = _begins(h)
            many = np.diff(np.append(np.flatnonzero(new), len(h))) > 1
            known = many[np.cumsum(new) - 1] if len(h) else new
            out = [np.concatenate([x[new], x[known]]) for x in (h, d)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(np.arange(len(out[0])) >= new.sum())], names=["h", "doc_id", "known"])

    return texts.select("doc_id", "text").mapInArrow(run, "h long, doc_id long, known boolean")


def _alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h of known rows and of groups with two documents or more; rows are sorted by h and doc_id, known ones apart."""
    last, low, told = None, 0, True
    for batch in batches:
        h, d, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        out_d, out_h = [d[known]], [h[known]]
        h, d = h[~known], d[~known]
        if len(h):
            new = _begins(h)
            new[0] = h[0] != last
            firsts, group = np.flatnonzero(new), np.cumsum(new)  # group 0 began in an earlier batch
            lows, names = np.append(low, d[firsts]), np.append(last or 0, h[firsts])
            later = d != lows[group]
            alive = np.zeros(len(lows), bool)
            alive[group[later]] = True
            tell = alive.copy()
            tell[0] &= not told
            out_d += [d[later], lows[tell]]
            out_h += [h[later], names[tell]]
            told = bool(alive[-1]) or (len(firsts) == 0 and told)
            last, low = h[-1], lows[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_d)), pa.array(np.concatenate(out_h))], names=["doc_id", "h"])


def runs_of(words: np.ndarray, doc: np.ndarray, alive: np.ndarray, window: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts' words the windows whose smallest short window is alive: places, short windows' hashes, own hashes."""
    _, _, low = kept_shorts(words, doc, window, short)
    at = np.flatnonzero(np.isin(low.view(np.int64), alive) & (low > 0))
    w = gram_hashes(words, window, _MULS[0])[at] if len(at) else np.zeros(0, np.uint64)
    return at, low[at].view(np.int64), w.view(np.int64)


def _held(fresh: DataFrame, window: int, short: int) -> DataFrame:
    """slot, alive: the short windows of each document that other documents have too."""
    parts = int(fresh.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shorts = _shorts(fresh, window, short).repartition(parts, F.when(F.col("known"), F.col("doc_id")).otherwise(F.col("h")))
    alive = shorts.sortWithinPartitions("known", "h", "doc_id").mapInArrow(_alive, "slot long, h long")
    return alive.groupBy("slot").agg(F.collect_list("h").alias("alive"))


def _found(batch: pa.RecordBatch, window: int, short: int) -> tuple[np.ndarray, ...]:
    """Of the texts in column 2 and the alive short windows in column 3: row, place and both hashes of each window."""
    made = [(np.zeros(0, np.int64),) * 4]
    for a, b, words, doc in _parts(batch.column(2)):
        at, h, w = runs_of(words, doc, np.unique(batch.column(3).slice(a, b - a).flatten().to_numpy(zero_copy_only=False)), window, short)
        of = doc[at]
        made.append((of + a, at - np.searchsorted(doc, of), h, w))
    return tuple(np.concatenate(x) for x in zip(*made))


def _survivors(texts: DataFrame, window: int, short: int) -> DataFrame:
    """doc_id, row, text, alive of documents with short windows that others have."""
    fresh = texts.filter("fresh")
    return fresh.join(_held(fresh, window, short).hint("shuffle_hash"), "slot").select("doc_id", "row", "text", "alive")


def occurrences(texts: DataFrame, window: int = WINDOW, short: int = SHORT) -> DataFrame:
    """doc_id, row, pos, n, first, h, ws: runs of n windows whose smallest short window, with hash h, other documents have
    too; ws are the windows' own hashes. Runs that a smaller doc_id of the same batch has come without h and ws, and so
    do runs equal to one of the same text from `first` on (else -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            of, pos, h, w = _found(batch, window, short)
            if not len(of):
                continue
            order = np.lexsort((of, ids[of], w, h))
            start = _begins(h[order], w[order])
            low, same = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
            low[order] = ids[of][order][start][np.cumsum(start) - 1]
            start |= _begins(of[order])
            same[order] = pos[order][start][np.cumsum(start) - 1]
            kind = np.where(ids[of] > low, 2, (same != pos).astype(np.int64))
            first = np.where(kind == 1, same, -1)
            new = _begins(of, kind, np.where(kind == 0, h, 0), pos - np.arange(len(pos)), np.where(kind == 1, pos - same, 0))
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(of)))
            ends = np.append(0, np.cumsum(np.where(kind[start] == 0, size, 0)))
            ws = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(w[kind == 0]))
            columns = [ids[of[start]], rows[of[start]], *(x.astype(np.int32) for x in (pos[start], size, first[start]))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(h[start], mask=kind[start] > 0), ws], names=["doc_id", "row", "pos", "n", "first", "h", "ws"])

    found = _survivors(texts, window, short).mapInArrow(run, "doc_id long, row long, pos int, n int, first int, h long, ws array<long>")
    return materialise(found, "runs")


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row, pos of rows h, w, doc_id, row, pos, sorted by the first three, whose group began with a smaller doc_id."""
    last, low = None, 0
    for batch in batches:
        h, w, d = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(h):
            continue
        new = _begins(h, w)
        new[0] = (h[0], w[0]) != last
        lows = np.append(low, d[new])
        yield batch.filter(pa.array(d > lows[np.cumsum(new)])).select(["doc_id", "row", "pos"])
        last, low = (h[-1], w[-1]), lows[-1]


def covered(texts: DataFrame, window: int = WINDOW, short: int = SHORT) -> DataFrame:
    """slot, row, marks (pos, n, first): runs of n windows that a document with a smaller doc_id has too, if those from
    `first` on are some (-1: in any case)."""
    spark = texts.sparkSession
    found = occurrences(texts, window, short)
    each = found.filter("h is not null").select("doc_id", "row", "h", "pos", F.posexplode("ws").alias("i", "w")).select("h", "w", "doc_id", "row", (F.col("pos") + F.col("i")).alias("pos"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    later = each.repartition(parts, "h", "w").sortWithinPartitions("h", "w", "doc_id").mapInArrow(_later, "doc_id long, row long, pos int")
    marks = later.select("*", F.lit(1).alias("n"), F.lit(-1).alias("first")).unionByName(found.filter("h is null").select("doc_id", "row", "pos", "n", "first"))
    marks = materialise(marks.groupBy(F.col("doc_id").alias("slot"), "row").agg(F.collect_list(F.struct("pos", "n", "first")).alias("marks")), "covered")
    discard(found)
    return marks


def repeats(docs: DataFrame, window: int = WINDOW, short: int = SHORT) -> DataFrame:
    """doc_id, row, pos, size: windows shared by documents, texts that equal an earlier one set aside, at the largest
    doubled length at which each place still is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, pos, h, w = _found(batch, window, short)
            ids, rows = (batch.column(i).to_numpy(zero_copy_only=False)[of] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, rows, pos, h, w)], names=["doc_id", "row", "pos", "h1", "h2"])

    level = _survivors(laid(docs, copies(docs)), window, short).mapInArrow(run, "doc_id long, row long, pos long, h1 long, h2 long")
    level = materialise(level, "repeats")
    size, out = window, None
    while True:
        level = materialise(level.join(_shared(level, "h1", "h2").select("h1", "h2"), ["h1", "h2"]).select("doc_id", "row", "pos", "h1", "h2").distinct(), "repeats")
        if level.isEmpty():
            break
        now = level.select("doc_id", "row", "pos", F.lit(size).alias("size"))
        out = now if out is None else out.unionByName(now)
        later = level.select("doc_id", "row", (F.col("pos") - size).alias("pos"), F.col("h1").alias("n1"), F.col("h2").alias("n2"))
        level = level.join(later, ["doc_id", "row", "pos"]).select("doc_id", "row", "pos", F.xxhash64("h1", "n1").alias("h1"), F.xxhash64("h2", "n2", F.lit(1)).alias("h2"))
        size *= 2
    if out is None:
        return level.select("doc_id", "row", "pos", F.lit(size).alias("size"))
    return out.groupBy("doc_id", "row", "pos").agg(F.max("size").alias("size"))


def kept_words(text: bytes | None, runs: list[dict] | None, window: int = WINDOW) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were; `runs` are marks as of `covered`."""
    words = (text or b"").split()
    if not runs:
        return words, len(words)
    pos, n, first = (np.array([r[k] for r in runs]) for k in ("pos", "n", "first"))
    delta = np.zeros(len(words) + 1, np.int64)
    np.add.at(delta, pos[first < 0], 1)
    np.add.at(delta, (pos + n)[first < 0], -1)
    begins = np.cumsum(delta) > 0
    for p, k, f in zip(pos[first >= 0], n[first >= 0], first[first >= 0]):
        begins[p : p + k] |= begins[f : f + k]
    ends = np.cumsum(np.concatenate([np.zeros(window, np.int64), begins]))
    return list(compress(words, (ends[window : window + len(words)] == ends[: len(words)]).tolist())), len(words)


def deduplicated(docs: DataFrame, window: int = WINDOW, short: int = SHORT, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with texts, kept (the words that stay, joined by spaces)."""
    rows = laid(docs, copies(docs))
    marks = covered(rows, window, short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sums, kept = [], [], [], []
            for text, runs, copy in zip(binary(batch.column(1)), batch.column(2), batch.column(3).to_pylist()):
                words, total = kept_words(text, runs.as_py(), window)
                if copy and total >= window:
                    words = []
                joined = b" ".join(words)
                n.append(total)
                gone.append(total - len(words))
                sums.append(hashlib.sha256(joined).hexdigest())
                if texts:
                    kept.append(joined.decode())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.string())] if texts else [])], names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * texts])

    rows = rows.join(marks.hint("shuffle_hash"), ["slot", "row"], "left").withColumn("marks", F.when(F.col("doc_id").isNotNull(), F.col("marks")))
    return rows.select("doc_id", "text", "marks", "copy").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), texts=False)


ORACLE_SQL = r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
wins as (
  select doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) as g
  from (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as i from w where len(w) >= 13)),
firsts as (select g, min(doc_id) as low from wins group by g),
starts as (select w.doc_id, list(w.i) as s from wins w join firsts f using (g) where w.doc_id > f.low group by w.doc_id),
gone as (select doc_id, list_distinct(flatten(list_transform(s, lambda x: generate_series(x, x + 12)))) as p from starts),
kept as (
  select w.doc_id, len(w.w) as n, coalesce(len(g.p), 0) as r,
    case when g.p is null then w.w else list_transform(list_filter(list_zip(w.w, generate_series(1, len(w.w)), list_transform(generate_series(1, len(w.w)), lambda x: list_contains(g.p, x))), lambda z: not z[3]), lambda z: z[1]) end as k
  from w left join gone g using (doc_id))
select doc_id, n::bigint as n_words, r::bigint as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""
