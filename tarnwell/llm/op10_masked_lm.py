"""Documents scored by masked pseudo-likelihood.

A network predicts each word from the two words on either side: position-wise embeddings are summed and passed through
tanh; one softmax over the hidden values gives the word's frequency class, and another, with weights of its own for each
word, the word in its class. A document's score is the sum of its words' conditional log-probabilities, and that sum over
its words.

Word counts are taken over all documents. The `VOCABULARY` most frequent words are the network's own; the others, however
many, lie in a table of hash buckets that grows with the number of distinct words, to `TAIL` buckets of a byte each: the
mean count of the bucket's words in eighths of powers of two. A bucket's level of frequency is its class, and in its
class a word has the share of such a count.

Training sees every word: the texts are laid out in units by a hash of the row, a number of them that only the length of
all texts sets; in each of `ROUNDS` rounds every unit trains a copy of the network on every `STRIDE`-th word, from the
round's number on, and the copies are averaged in fixed point, slice by slice, by two shuffles whose groups are streamed
and never held. So the network, and every score, is the same however the table is partitioned. Only the averaged network
and the table of buckets, whose sizes are bounded, come to the driver.

Defined cases: null and empty texts have no words, a log-likelihood of 0 and a null mean; repeated rows get equal scores;
null doc_ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm._common import binary, chunks, discard, laid_out, materialise, table
from tarnwell.llm.op3_substring_dedup import word_hashes

NAME = "op10_masked_lm"
VOCABULARY = 4096
CLASSES = 48
TAIL = 1 << 24  # buckets of other words, at most
STEPS = 256
LEVELS = 8  # classes of other words
OTHERS = 512  # their entries as context
WIDTH = 16
ROUNDS = 2
STRIDE = 2
RATE = 0.2
BATCH = 8192
UNIT = 32 << 20  # bytes of text
UNITS = (8, 1 << 17)
NEAR = (-2, -1, 1, 2)
SLICE = 8192
FIXED = 1 << 24
CHUNK = 1 << 20


def words_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts, 64-bit hashes of their words (A-Z lower-cased) and the words' text numbers in the range."""
    for a, b in chunks(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), CHUNK):
        yield a, b, *word_hashes([(t or b"").lower() for t in binary(texts.slice(a, b - a))])


def counts(docs: DataFrame) -> DataFrame:
    """h (a word's hash), n over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.zeros(0, np.uint64), *(h for _, _, h, _ in words_of(batch.column(0)))]
            h, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, size: int = VOCABULARY, classes: int = CLASSES, tail: int = TAIL) -> dict:
    """The network's words; for each number its class and its log-share of the class; each class's mass."""
    counted = materialise(counts(docs), "word-counts")
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ranked = counted.orderBy(F.col("n").desc(), "h").limit(size)
    top = ranked.collect()
    buckets = min(tail, 1 << max(int(2 * (distinct - len(top))).bit_length(), 4))
    rest = counted.join(F.broadcast(ranked.select("h")), "h", "left_anti").groupBy(F.col("h").bitwiseAND(F.lit(buckets - 1)).cast("int").alias("b"))
    mean = F.least(F.round(F.log2(F.sum("n") / F.count("*")) * 8), F.lit(STEPS - 1))
    rest = materialise(rest.agg(mean.cast("int").alias("q"), F.count("*").alias("k")), "word-buckets")
    words = np.zeros(STEPS)
    for r in rest.groupBy("q").agg(F.sum("k").alias("k")).collect():
        words[r.q] = r.k
    held, tail = rest.select("b", "q").toArrow(), np.zeros(buckets, np.uint8)  # at most `tail` rows
    tail[held["b"].to_numpy()] = held["q"].to_numpy()
    discard(counted, rest)
    n, step = np.array([r.n for r in top], float), np.exp2(np.arange(STEPS) / 8)
    of = np.minimum(np.floor((np.cumsum(n) - n) / max(n.sum(), 1) * classes), classes - 1).astype(np.int64)
    level = classes + np.minimum(np.arange(STEPS) // 8, LEVELS - 1)
    mass = np.bincount(of, n, classes + LEVELS) + np.bincount(level, words * step, classes + LEVELS)
    of, each = np.concatenate([of, level]), np.concatenate([n, step])  # of the words, then of the steps
    inside = np.log(each / np.maximum(mass[of], each)).astype(np.float32)
    known = np.array([r.h for r in top], np.int64).view(np.uint64)
    rank = np.argsort(known)
    return {"known": known[rank], "rank": rank, "tail": tail, "class": of.astype(np.int8), "inside": inside, "mass": mass, "size": len(top)}


def numbered(hashes: np.ndarray, vocab: dict) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word, its rank in the vocabulary or behind that its bucket's step, and its entry as context."""
    bucket = (hashes & np.uint64(len(vocab["tail"]) - 1)).astype(np.int64)
    ids, entry = vocab["size"] + vocab["tail"][bucket].astype(np.int64), vocab["size"] + bucket % OTHERS
    if vocab["size"]:
        at = np.minimum(np.searchsorted(vocab["known"], hashes), vocab["size"] - 1)
        own = vocab["known"][at] == hashes
        ids, entry = np.where(own, vocab["rank"][at], ids), np.where(own, vocab["rank"][at], entry)
    return ids, entry


PARTS = ("e", "w", "b", "u")


def start(vocab: dict, seed: int = 3) -> dict[str, np.ndarray]:
    """Embeddings e of each place around a word, weights w and b of the classes, u of the words in their class."""
    rng, k = np.random.default_rng(seed), len(vocab["mass"])
    rows = vocab["size"] + OTHERS + 1  # the last stands for a text's edges
    mass = np.log((vocab["mass"] + 1) / (vocab["mass"] + 1).sum())
    net = {"e": rng.normal(0, 0.1, (len(NEAR), rows, WIDTH)), "w": rng.normal(0, 0.1, (WIDTH, k)), "b": mass, "u": np.zeros((vocab["size"], WIDTH))}
    return {k: v.astype(np.float32) for k, v in net.items()}


def contexts(entry: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Entries around each word [words, 4] of texts with numbers doc; texts are kept apart by edges."""
    line = np.full(len(entry) + 2 * (int(doc[-1]) + 2 if len(doc) else 1), size + OTHERS)
    at = np.arange(len(entry)) + 2 * (doc + 1)
    line[at] = entry
    return np.stack([line[at + d] for d in NEAR], 1)


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z), scaled so that each column's largest is 1, and the logarithm of the column sums of exp(z). Overwrites z."""
    top = z.max(0)
    z -= top
    np.exp(z, out=z)
    return z, np.log(z.sum(0)) + top


def hidden(net: dict, around: np.ndarray) -> np.ndarray:
    """Hidden values [width, words]."""
    h = net["e"][0][around[:, 0]]
    for j in range(1, len(NEAR)):
        h += net["e"][j][around[:, j]]
    return np.tanh(np.ascontiguousarray(h.T))


def _inner(vocab: dict, goal: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """Places of the words of each class of the network's own words, and where that class begins and ends."""
    own = np.flatnonzero(goal < vocab["size"])
    order = own[np.argsort(vocab["class"][goal[own]], kind="stable")]
    of = vocab["class"][goal[order]]
    cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
    first = vocab["class"][: vocab["size"]]
    for rows in np.split(order, cuts) if len(order) else []:
        c = vocab["class"][goal[rows[0]]]
        yield rows, *np.searchsorted(first, [c, c + 1])


def log_likelihoods(net: dict, vocab: dict, around: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Conditional log-probability of each word."""
    h, of = hidden(net, around), vocab["class"][goal]
    z = net["w"].T @ h + net["b"][:, None]
    out = z[of, np.arange(len(goal))]
    out -= _exp(z)[1]
    for rows, a, b in _inner(vocab, goal):
        z = net["u"][a:b] @ h[:, rows] + vocab["inside"][a:b, None]
        out[rows] += z[goal[rows] - a, np.arange(len(rows))]
        out[rows] -= _exp(z)[1]
    other = goal >= vocab["size"]
    out[other] += vocab["inside"][goal[other]]
    return out


def learn(net: dict, seen: dict, vocab: dict, around: np.ndarray, goal: np.ndarray) -> None:
    """One Adagrad step on the mean log-loss of a batch."""
    n, root = np.float32(len(goal)), np.float32(np.sqrt(len(goal)))

    def off(z: np.ndarray, at: np.ndarray) -> np.ndarray:
        z, _ = _exp(z)
        z /= z.sum(0)
        z[at, np.arange(len(at))] -= 1
        return z

    h = hidden(net, around)
    g = off(net["w"].T @ h + net["b"][:, None], vocab["class"][goal])
    back, grads = net["w"] @ g, {"w": h @ g.T / n, "b": g.mean(1), "u": np.zeros_like(net["u"])}
    for rows, a, b in _inner(vocab, goal):
        own = h[:, rows]
        g = off(net["u"][a:b] @ own + vocab["inside"][a:b, None], goal[rows] - a)
        grads["u"][a:b] = g @ own.T / root
        back[:, rows] += net["u"][a:b].T @ g
    back *= (1 - h * h) / root
    grads["e"] = np.empty_like(net["e"])
    for j in range(len(NEAR)):
        for k in range(WIDTH):
            grads["e"][j, :, k] = np.bincount(around[:, j], back[k], net["e"].shape[1])
    for name, grad in grads.items():
        seen[name] += grad * grad
        net[name] -= np.float32(RATE) * grad / np.sqrt(seen[name])


def _flat(net: dict) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in PARTS])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in PARTS:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of copies and values for each slice, from rows sorted by slice."""
    now, copies, total = None, 0, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([copies], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slice", "copies", "v"])

    for batch in batches:
        for s, c, v in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if s != now:
                if now is not None:
                    yield out()
                now, copies, total = s, 0, 0
            copies, total = copies + c, total + np.frombuffer(v, np.int64)
    if now is not None:
        yield out()


def units(docs: DataFrame) -> DataFrame:
    """text, row, laid out in units and in an order that only the rows set."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = docs.select("text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row")).filter("text is not null")
    return laid_out(rows, "row", "units", min(max(size // UNIT, UNITS[0]), UNITS[1]))


def train_round(texts: DataFrame, net: dict, vocab: dict, turn: int, stride: int = STRIDE) -> dict:
    """The average of the copies that the units train from `net`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: v.copy() for k, v in net.items()}
        seen = {k: np.full_like(v, 0.1) for k, v in net.items()}
        steps, held_x, held_y, n = 0, [], [], 0

        def step(x: np.ndarray, y: np.ndarray) -> None:
            nonlocal steps
            learn(own, seen, vocab, x, y)
            steps += 1

        for batch in batches:
            for _, _, hashes, doc in words_of(batch.column(0)):
                ids, entry = numbered(hashes, vocab)
                now = (np.arange(len(ids)) - np.searchsorted(doc, doc)) % stride == turn % stride
                held_x.append(contexts(entry, doc, vocab["size"])[now])
                held_y.append(ids[now])
                n += len(held_y[-1])
                if n >= BATCH:
                    x, y = np.concatenate(held_x), np.concatenate(held_y)
                    for i in range(0, n - BATCH + 1, BATCH):
                        step(x[i : i + BATCH], y[i : i + BATCH])
                    done = n // BATCH * BATCH
                    held_x, held_y, n = [x[done:]], [y[done:]], n - done
        if n:
            step(np.concatenate(held_x), np.concatenate(held_y))
        if steps:
            fixed = np.round(_flat(own).astype(np.float64) * FIXED).astype(np.int64)
            parts = [fixed[i : i + SLICE] for i in range(0, len(fixed), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([1] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "copies", "v"])

    kind = "slice int, copies long, v binary"
    copies = texts.select("text").mapInArrow(run, kind)
    for keys in (["slice", "salt"], ["slice"]):
        dealt = copies.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(16))) if len(keys) == 2 else copies
        copies = dealt.repartition(*keys).sortWithinPartitions(*keys).select("slice", "copies", "v").mapInArrow(_summed, kind)
    rows = sorted(copies.collect(), key=lambda r: r.slice)  # the network itself
    if not rows:
        return net
    return _shaped(np.concatenate([np.frombuffer(r.v, np.int64) / (r.copies * float(FIXED)) for r in rows]), net)


def scored(docs: DataFrame, net: dict, vocab: dict) -> DataFrame:
    """doc_id, n_words, log_likelihood, mean_log_likelihood for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, hashes, doc in words_of(batch.column(1)):
                goal, entry = numbered(hashes, vocab)
                around, each = contexts(entry, doc, vocab["size"]), np.empty(len(goal))
                for i in range(0, len(goal), 16384):
                    each[i : i + 16384] = log_likelihoods(net, vocab, around[i : i + 16384], goal[i : i + 16384])
                n = np.bincount(doc, minlength=b - a)
                s = np.zeros(b - a)
                s[n > 0] = np.add.reduceat(each, np.flatnonzero(np.diff(doc, prepend=-1))) if len(doc) else 0
                mean = pa.array(np.round(s / np.maximum(n, 1), 4), mask=n == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(np.round(s, 2)), mean], names=["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double")


def fit(docs: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE) -> tuple[dict, dict]:
    """The network and its vocabulary."""
    vocab, texts = vocabulary(docs), units(docs)
    net = start(vocab)
    for turn in range(rounds):
        net = train_round(texts, net, vocab, turn, stride)
    discard(texts)
    return net, vocab


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, *fit(docs))
