"""Whole queries over small tables, against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash

from tarnwell.llm import op1_fingerprints, op2_pii, op4_licenses, op5_quality, op9_simhash_dedup

RNG = random.Random(12)
WORDS = [f"{a}{b}" for a in "the of and river stone moon light Über".split() for b in ("", "s", "ing", "er", "ly")]
MARKS = ["mail a.b@c.example.org", "from 10.1.2.3 or 300.1.2.3", "card 4111 1111 1111 1111", "call +1 (555) 010-9999", "licensed under CC BY", "All rights reserved", "GNU General Public License"]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    base = [prose(RNG.randrange(1, 80)) for _ in range(60)]
    marked = [f"{prose(9)} {RNG.choice(MARKS)} {prose(5)} {RNG.choice(MARKS)}" for _ in range(30)]
    near = [b + " zz" for b in base[:15]] + base[:8] + [base[0]] * 5 + [base[2].upper(), "", "  ", None, None]
    return dict(enumerate(base + marked + near))


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in corpus.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(d, int(d % 4 > 0), 0) for d in corpus if d % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def by_id(df):
    rows = df.collect()
    assert len(rows) == len({r.doc_id for r in rows})
    return {r.doc_id: r for r in rows}


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def fingerprint(text):
    """Weighted votes of the hashes of neighbouring words."""
    w = re.split(r"[\t-\r ]+", text.lower())
    votes, total = [0] * 64, 0
    for x, y in zip(w, [*w[1:], ""]):
        h = xxhash.xxh64_intdigest(y.encode(), xxhash.xxh64_intdigest(x.encode(), 42))
        weight = min(len(x) + len(y), op1_fingerprints.MOST)
        total += weight
        for b in range(64):
            votes[b] += weight * (h >> b & 1)
    return sum(1 << b for b in range(64) if votes[b] * 2 > total)


def test_fingerprints(spark, folder, corpus):
    got = by_id(op1_fingerprints.query(spark, folder))
    ids = sorted(corpus, reverse=True)
    fps = {d: fingerprint(t or "") for d, t in corpus.items()}
    for at, d in enumerate(ids):
        t, after = corpus[d] or "", ids[(at + 1) % len(ids)]
        k = len(t) // 3
        edited = t[: len(t) - k] + (corpus[after] or "")[:k]
        fp = fingerprint(edited)
        like = lambda a, b: 1 - (a ^ b).bit_count() / 64
        near = [e for e in corpus if e != d and (fps[e] ^ fps[d]).bit_count() <= op1_fingerprints.RADIUS]
        want = (len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{fps[d]:016x}", f"{fp:016x}", like(fps[d], fp), like(fps[d], fps[after]), min(e for e in corpus if fps[e] == fps[d]), len(near))
        assert tuple(got[d])[1:] == want


@pytest.mark.parametrize("hot", [1, 8, 256])
def test_block_tables_of_any_size(spark, hot):
    centre = [RNG.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in RNG.sample(range(64), RNG.randrange(0, 4))) for c in centre for _ in range(40)}
    fps |= {centre[0] & ~0xFFFFFFFF | RNG.getrandbits(32) for _ in range(60)}
    want = {(signed(a), signed(b), (a ^ b).bit_count()) for a in fps for b in fps if signed(a) < signed(b) and (a ^ b).bit_count() <= 3}
    got = [tuple(r) for r in op1_fingerprints.near_pairs(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), hot=hot).collect()]
    assert len(got) == len(want) and set(got) == want


def test_personal_data(spark, folder, corpus):
    got = by_id(op2_pii.query(spark, folder))
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(s):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(s))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    for d, t in corpus.items():
        t = t or ""
        kinds = {
            "email": list(email.finditer(t)),
            "ip": [m for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))],
            "card": [m for m in card.finditer(t) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))],
            "phone": [m for m in phone.finditer(t) if 8 <= len(digits(m.group())) <= 15],
        }
        base = [f"{k}:{m.start()}:{m.end()}" for k, ms in kinds.items() for m in ms]
        assert (got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone) == tuple(map(len, kinds.values()))
        assert got[d].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = [s.split(":") for s in got[d].spans.split(",") if s]
        assert set(base) <= {":".join(s) for s in spans}
        assert spans == sorted(spans, key=lambda s: (list(kinds).index(s[0]), int(s[1])))


def test_licences(spark, folder, corpus):
    got = by_id(op4_licenses.query(spark, folder))
    for d, t in corpus.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        at = [(i, label) for p, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        base = {label for _, label in at}
        first, last = (min(at)[0], max(at)[0]) if at else (None, None)
        assert tuple(got[d])[1:6] == (len(w), len(at), first, last, ",".join(sorted(base)))
        labels = [x for x in got[d].labels.split(",") if x]
        assert base <= set(labels) and labels == sorted(set(labels)) and 0 <= got[d].score <= 1


def test_quality(spark, folder, corpus):
    got = by_id(op5_quality.query(spark, folder))
    assert set(got) == set(corpus)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    texts = {}
    for d, t in corpus.items():
        assert texts.setdefault(t or "", got[d].score) == got[d].score


def test_simhash_components(spark, folder, corpus):
    got = by_id(op9_simhash_dedup.query(spark, folder))
    fps = {}
    for d, t in corpus.items():
        w = re.findall(r"[^\x20\t-\r]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[d] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    component = {d: d for d in corpus}
    changed = True
    while changed:
        changed = False
        for a in corpus:
            low = min(component[b] for b in corpus if (fps[a] ^ fps[b]).bit_count() <= 2)
            changed, component[a] = changed or low < component[a], min(low, component[a])
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{fps[d]:016x}", component[d]) for d in corpus}
