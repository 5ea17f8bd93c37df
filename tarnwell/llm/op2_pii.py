"""Personal data: fixed patterns, and a linear-chain CRF over word shapes for what they miss.

The CRF tags tokens (digit runs, letter runs, single signs) with B/I labels of four kinds from their shapes, a few cue
words and the shapes around them. It is trained by log-likelihood on a small labelled table written out below, and
decoded by Viterbi over padded numpy batches. Its sequences are the stretches of text around digits, at-signs and
spelled-out "(at)" or "dot" in any case; elsewhere no token can begin a span, so nothing is decoded there. Stretches of
over `LONGEST` tokens are decoded in pieces that share `SHARED` tokens on either side; the piece in whose own part a span
begins gives it. A tagged span counts if it passes its kind's check and
meets no span of the patterns; the patterns' spans always stay.

Defined cases: null and empty texts have no spans; repeated rows give equal rows; an empty table gives an empty
result; null doc_ids are kept; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm._common import table

NAME = "op2_pii"
KINDS = ("email", "ip", "card", "phone")
STATES = ["O", *(f"{b}-{k}" for k in KINDS for b in "BI")]
LONGEST = 400
SHARED = 64
AROUND = 40

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")  # as from any start, without trying each digit of a run
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[(] ?(?:[aA][tT]|[dD][oO][tT]) ?[\])]| [dD][oO][tT] ")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in re.findall("[0-9]+", text))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the fixed patterns, leftmost and without overlap within a kind."""
    emails, last = [], 0
    if "@" in text:
        for m in _AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL_SIGNS:
                start -= 1
            if start < m.start():
                emails.append((start, m.end()))
                last = m.end()
    ips, cards, phones = [], [], []
    if _DIGIT.search(text):
        ips = [m.span() for m in _IP.finditer(text) if _octets(m.group())]
        cards = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d)]
        if "+" in text:
            phones = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return {"email": emails, "ip": ips, "card": cards, "phone": phones}


# --- the labelled table: [kind:span] marks a span; {dN} N digits, {o} 0..255, {w} a word, {W} a capitalised one
LABELLED = """
write to [email:{w} (at) {w} (dot) com] for {w}
mail [email:{w}.{w} [at] {w} [dot] org] and {w} {w}
{w} {w} [email:{w}(at){w}.com] {w}
{W} [email:{w} (at) {w}.example.net] {w} {w}
{w} [email:{w}{d2}(at)mail{d1}(dot){w}(dot)com], {w}
contact [email:{w} @ {w} . com] {w}
send mail to [email:{w} at {w} dot com] {w} {w}
email [email:{w}.{d2} at {w} dot example dot org] or {w}
{w} {w} [email:{w}.{d2}@{w}{d1}.example.com] {w} {w}
call [phone:({d3}) {d3}-{d4}] {w} {w}
{w} {w} [phone:({d3}) {d3}-{d4}] {w}, {w}
{w} [phone:{d3}-{d3}-{d4}] {w} {w}
phone [phone:{d3}.{d3}.{d4}] {w}
tel [phone:0{d3} {d6}] {w}
tel: [phone:0{d2}-{d7}] {w}
fax [phone:{d3} {d3} {d4}] {w} {w}
{w} [phone:+1 ({d3}) {d3}-{d4}] {w} {w}
{w} [phone:+{d2} {d3} {d7}] {w}
phone: [phone:1-{d3}-{d3}-{d4}], {w}
{w} [ip:{o}[.]{o}[.]{o}[.]{o}] {w}
host [ip:{o} . {o} . {o} . {o}] {w} {w}
server [ip:{o}(.){o}(.){o}(.){o}] {w}
ip [ip:{o}-{o}-{o}-{o}] {w}
{w} {w} [ip:{o}.{o}.{o}.{o}] {w}
card [card:{d4}.{d4}.{d4}.{d4}] {w}
{w} card [card:{d4}/{d4}/{d4}/{d4}] {w}
{w} [card:{d4}-{d4}-{d4}-{d4}] {w}
visa [card:{d4} {d4} {d4} {d4}] {w}
card [card:{d4} {d6} {d5}] {w}
card number [card:{d4}-{d6}-{d5}] {w}
{w} {w} [card:{d16}] {w} {w}
{w} on {d4}-{d2}-{d2} {w} {w}
{w} {d2}.{d2}.{d4} {w}
{w} {w} {d2}/{d2}/{d4}, {w}
version {d1}.{d1}.{d2} {w}
{W} version {d1}.{d1} {w} {w}
licensed under {W} {d1}.{d1}. {w}
the {w} {d4}-{d4} {w} {w}
{w} page {d2} of {d3} {w}
{w} pp. {d3}-{d3} {w}
{w} {d1},{d3} {w} and {d2},{d3},{d3} {w}
{w} ${d2}.{d2} {w} {w}
{w} {d2}% {w} {w} {d3} {w}
token = "{w}{d3}{w}{d2}{w}{d4}" {w}
key: {w}{d5}{w}{d2} {w}
{w} {d10} {w} {w}
id {d8}-{d4} {w}
{w} isbn {d3}-{d1}-{d2}-{d6}-{d1} {w}
{w} {d2}:{d2} {w} {w} {d2}:{d2}:{d2} {w}
{w} ({d4}) {w} {w} [{d2}] {w}
{w} ({d3}) {w} {w}
{w} @ {w} {w} @{w} {w}
{w} {w} dot {w} {w} at {w}
{w} (at) {w} {w} at {w} {d2} {w}
{W} {w} {w} | {w} {d3} | {w}
{w} {d1} {d1} {d1} {d1} {w} {d2} {d2}
{w} {d3} {w} {d3} {w} {d4} {w}
{w} section {d1}.{d1}.{d1}.{d3} {w}
""".strip().split("\n")
_WORDS = "alpha river stone the of and with quick mora tion le der queeaux form stand bright ana leed item north chen".split()


def labelled_rows(copies: int = 6, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with their spans (start, end, kind)."""
    rng, rows = random.Random(seed), []

    def fill(m: re.Match) -> str:
        code = m.group(1)
        if code == "w":
            return rng.choice(_WORDS)
        if code == "W":
            return rng.choice(_WORDS).title()
        if code == "o":
            return str(rng.randrange(256))
        return "".join(rng.choice("0123456789") for _ in range(int(code[1:])))

    for line in LABELLED:
        for _ in range(copies):
            lead, tail = (" ".join(rng.choice(_WORDS) for _ in range(rng.randrange(4))) for _ in range(2))
            got, spans, text = re.sub(r"\{(\w+)\}", fill, line), [], lead + " " if lead else ""
            m = re.match(r"(.*?)\[(email|ip|card|phone):(.*)\](.*)\Z", got)
            if m:
                text += m[1]
                spans.append((len(text), len(text) + len(m[3]), m[2]))
                text += m[3] + m[4]
            else:
                text += got
            rows.append((f"{text} {tail}".rstrip(), spans))
    return rows


# --- features
_CUES = {w: i for i, w in enumerate("at dot com org net phone tel call fax card visa number ip host server mail email contact version page date license section isbn id token key".split())}
_SIGNS = {c: i for i, c in enumerate(".-()+@/:,[]{}\"$%#|_=")}
_SHAPES = 8 + 6 + len(_SIGNS) + 1 + 1  # digits, letters, signs, other sign, edge
_EDGE = _SHAPES - 1
_BLOCKS = [_SHAPES] * 5 + [len(_CUES) + 1] * 3 + [_SHAPES * 2]
_OFFSETS = np.concatenate([[0], np.cumsum(_BLOCKS)[:-1]])
N_FEATURES = int(sum(_BLOCKS))


def _shape(token: str) -> int:
    c = token[0]
    if c in "0123456789":
        return min(len(token), 8) - 1 if len(token) < 8 else 7
    if c.isalpha():
        if token.isupper():
            return 8 + (len(token) > 1)
        return 8 + (2 if c.isupper() else 3 if len(token) < 4 else 4 if len(token) < 9 else 5)
    return 14 + _SIGNS.get(c, len(_SIGNS))


def token_features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Feature numbers [tokens, blocks]."""
    tokens = [text[s:e] for s, e in spans]
    shape = np.array([_EDGE, _EDGE, *map(_shape, tokens), _EDGE, _EDGE])
    cue = np.array([len(_CUES), *(_CUES.get(t.lower(), len(_CUES)) for t in tokens), len(_CUES)])
    glued = np.array([i > 0 and spans[i - 1][1] == spans[i][0] for i in range(len(spans))], int)
    n = len(tokens)
    columns = [shape[2 : n + 2], shape[1 : n + 1], shape[3 : n + 3], shape[:n], shape[4 : n + 4], cue[1 : n + 1], cue[:n], cue[2 : n + 2], shape[2 : n + 2] * 2 + glued]
    return np.stack(columns, 1) + _OFFSETS


def _pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), int(lengths.max()), len(_BLOCKS)), int)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, lengths


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train_crf(rows: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 70, rate: float = 0.2, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission [features, states] and transition [states, states] weights by Adam on the mean log-likelihood."""
    xs, ys = [], []
    for text, spans in rows:
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        y = np.zeros(len(tokens), int)
        for s, e, kind in spans:
            inside = [i for i, (a, b) in enumerate(tokens) if a >= s and b <= e]
            y[inside] = STATES.index(f"I-{kind}")
            y[inside[0]] = STATES.index(f"B-{kind}")
        xs.append(token_features(text, tokens))
        ys.append(y)
    x, lengths = _pad(xs)
    b, t = x.shape[:2]
    y = np.zeros((b, t), int)
    for i, r in enumerate(ys):
        y[i, : len(r)] = r
    live = np.arange(t) < lengths[:, None]
    k = len(STATES)
    params = [np.zeros((N_FEATURES, k)), np.zeros((k, k))]
    seen = [np.zeros((N_FEATURES, k)), np.zeros((k, k))]
    np.add.at(seen[0], (x[live], y[live][:, None]), 1)
    pair = live[:, 1:]
    np.add.at(seen[1], (y[:, :-1][pair], y[:, 1:][pair]), 1)
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        emit = params[0][x].sum(2)
        fore, back = np.zeros((t, b, k)), np.zeros((t, b, k))
        fore[0] = emit[:, 0]
        for i in range(1, t):
            fore[i] = np.where(live[:, i, None], _lse(fore[i - 1][:, :, None] + params[1], 1) + emit[:, i], fore[i - 1])
        for i in range(t - 2, -1, -1):
            back[i] = np.where(live[:, i + 1, None], _lse(params[1] + (emit[:, i + 1] + back[i + 1])[:, None, :], 2), 0)
        total = _lse(fore[-1], 1)
        unary = np.exp(fore + back - total[:, None]).transpose(1, 0, 2) * live[..., None]
        hoped = [np.zeros((N_FEATURES, k)), np.zeros((k, k))]
        for c in range(x.shape[2]):
            np.add.at(hoped[0], x[live][:, c], unary[live])
        for i in range(t - 1):
            two = np.exp(fore[i][:, :, None] + params[1] + (emit[:, i + 1] + back[i + 1])[:, None, :] - total[:, None, None])
            hoped[1] += (two * live[:, i + 1, None, None]).sum(0)
        for j in (0, 1):
            g = (hoped[j] - seen[j]) / b + l2 * params[j]
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.99 * v[j] + 0.01 * g * g
            params[j] = params[j] - rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
    return params[0], params[1]


@functools.lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray]:
    return train_crf(labelled_rows())


def viterbi(emit: np.ndarray, step: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best state of each token; emit [rows, tokens, states]."""
    b, t, k = emit.shape
    best, came = emit[:, 0], np.zeros((t, b, k), np.int8)
    for i in range(1, t):
        all_ = best[:, :, None] + step
        came[i] = all_.argmax(1)
        best = np.where((i < lengths)[:, None], all_.max(1) + emit[:, i], best)
    out = np.zeros((b, t), int)
    state = best.argmax(1)
    for i in range(t - 1, -1, -1):
        out[:, i] = state
        state = np.where((i < lengths) & (i > 0), came[i][np.arange(b), state], state)
    return out


def stretches(text: str) -> Iterator[tuple[list[tuple[int, int]], int, int]]:
    """Tokens of each stretch that is decoded, and the places among them where spans may begin."""
    start = end = -1

    def tokens(s: int, e: int) -> Iterator[tuple[list[tuple[int, int]], int, int]]:
        while s > 0 and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        got = [m.span() for m in _TOKEN.finditer(text, s, e)]
        for i in range(0, len(got), LONGEST):
            begin = max(i - SHARED, 0)
            yield got[begin : i + LONGEST + SHARED], i - begin, i - begin + LONGEST

    for m in _TRIGGER.finditer(text):
        s, e = m.start() - AROUND, m.end() + AROUND
        if start >= 0 and s <= end:
            end = e
            continue
        if start >= 0:
            yield from tokens(max(start, 0), min(end, len(text)))
        start, end = max(s, 0, end), e
    if start >= 0:
        yield from tokens(start, min(end, len(text)))


def _holds(kind: str, span: str) -> bool:
    digits, span = re.sub("[^0-9]", "", span), span.lower()
    if kind == "email":
        return len(span) >= 6 and (bool(re.search(r"@|[\[(] ?at ?[\])]", span)) and bool(re.search(r"\.|\bdot\b", span)) or bool(re.search(r" at .* dot ", span))) and not span.startswith(("@", "at ")) and bool(re.search(r"[A-Za-z]{2,}[\])]?\Z", span))
    if kind == "ip":
        return len(re.findall("[0-9]+", span)) == 4 and _octets(span)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and not re.fullmatch(r"[0-9]+", span)


def _alone(text: str, s: int, t: int) -> bool:
    """Whether no letter or digit touches the span's ends from outside."""
    return not (text[s - 1 : s].isalnum() and text[s].isalnum()) and not (text[t : t + 1].isalnum() and text[t - 1].isalnum())


def find(texts: list[str | None], weights: tuple[np.ndarray, np.ndarray]) -> list[tuple[dict, dict]]:
    """For each text the patterns' spans and those that the CRF adds, by kind."""
    emission, step = weights
    base = [base_spans(t) if t else {k: [] for k in KINDS} for t in texts]
    added: list[dict] = [{k: [] for k in KINDS} for _ in texts]
    held: dict[int, tuple[list[int], list[int]]] = {}

    def taken(n: int, s: int, t: int) -> bool:
        """Whether [s, t) meets a span of the patterns."""
        if n not in held:
            merged: list[list[int]] = []
            for a, b in sorted(x for spans in base[n].values() for x in spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            held[n] = ([a for a, _ in merged], [b for _, b in merged])
        starts, ends = held[n]
        i = bisect.bisect_left(starts, t) - 1
        return i >= 0 and ends[i] > s

    found = [(n, *x) for n, t in enumerate(texts) if t for x in stretches(t)]
    found.sort(key=lambda x: len(x[1]))
    for i in range(0, len(found), 128):
        part = found[i : i + 128]
        x, lengths = _pad([token_features(texts[n], tokens) for n, tokens, *_ in part])
        states = viterbi(emission[x].sum(2), step, lengths)
        for (n, tokens, low, high), row in zip(part, states.tolist()):
            j, size = 0, len(tokens)
            while j < size:
                if row[j]:
                    kind, e = STATES[row[j]][2:], j + 1
                    inside = STATES.index(f"I-{kind}")
                    while e < size and row[e] == inside:
                        e += 1
                    s, t = tokens[j][0], tokens[e - 1][1]
                    if low <= j < high and _alone(texts[n], s, t) and _holds(kind, texts[n][s:t]) and not taken(n, s, t):
                        added[n][kind].append((s, t))
                    j = e
                else:
                    j += 1
    for spans in added:
        for kind in KINDS:
            spans[kind].sort()
    return list(zip(base, added))


def _join(spans: dict) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: counts and digest of the patterns' spans, all spans, and how many the CRF added."""
    weights = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for base, added in find(batch.column(1).to_pylist(), weights):
                for i, k in enumerate(KINDS):
                    columns[i].append(len(base[k]))
                columns[4].append(hashlib.sha256(_join(base).encode()).hexdigest())
                columns[5].append(_join({k: sorted(base[k] + added[k]) for k in KINDS}))
                columns[6].append(sum(map(len, added.values())))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[x.split()[0] for x in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)


def mask(text: str, spans: dict) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first."""
    out, at = [], 0
    for s, e, kind in sorted((s, e, k) for k in KINDS for s, e in spans[k]):
        if s < at:
            at = max(at, e)
            continue
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """docs with spans in `text` masked and `n_chars`, where there is one, counted anew."""
    weights, names = model(), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index("text")
            texts = batch.column(at).to_pylist()
            new = [mask(t, {k: b[k] + a[k] for k in KINDS}) if t else t for t, (b, a) in zip(texts, find(texts, weights))]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if "n_chars" in names:
                i = names.index("n_chars")
                changed = [None if c is None else len(t) if t != o else c for t, o, c in zip(map(lambda x: x or "", new), map(lambda x: x or "", texts), columns[i].to_pylist())]
                columns[i] = pa.array(changed, batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
