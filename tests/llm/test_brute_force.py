"""Operators that SQL cannot express, against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from tarnwell.llm import op1_fingerprints, op2_pii, op3_substring_dedup, op4_licenses, op5_quality, op6_decontaminate, op7_source_mix, op9_simhash_dedup, op10_masked_lm

RNG = random.Random(4)
WORDS = [f"{a}{b}" for a in "the of and river stone moon light".split() for b in ("", "s", "ing", "er", "ly", "ous")]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    base = [prose(RNG.randrange(1, 120)) for _ in range(60)]
    shared = prose(40)
    out = base + [b + " " + shared for b in base[:10]] + [base[3], base[3], base[4].upper(), "", " ".join(base[5].split()[:-1] + ["zzz"])]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)


def test_simhash_bits_by_hand():
    import xxhash

    text = "Alpha beta  GAMMA\tdelta alpha beta gamma"
    w = text.encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    assert op9_simhash_dedup.fingerprint(text.encode()) == want


@pytest.mark.parametrize("most", [2, 4096])
def test_links_and_components(spark, most):
    rng = random.Random(9)
    centre = [rng.getrandbits(64) for _ in range(12)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))) for c in centre for _ in range(25)} | {rng.getrandbits(64) for _ in range(100)}
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    parent = {s: s for s in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and (signed[a] ^ signed[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {r.a: r.b for r in op9_simhash_dedup.components(op9_simhash_dedup.links(df, 2, most)).collect()}
    assert got == {s: find(s) for s in signed if find(s) != s}


def test_parities_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(3)
    ruled = 0
    for _ in range(2000):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.4], rng.integers(0, 1 << 63, int(rng.integers(0, n // 3 + 1)), np.uint64)]))
        both = len(np.intersect1d(a, b))
        may = op9_simhash_dedup.may_be_similar(len(a), len(b), op9_simhash_dedup.parities(a), op9_simhash_dedup.parities(b))
        assert may or 5 * both < 4 * (len(a) + len(b) - both)
        ruled += not may
    assert ruled > 500


def test_permuted_tables_find_all(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(60)}
    fps |= {f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for f in list(fps) for _ in range(3)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {(a, b, ((a ^ b) & (2**64 - 1)).bit_count()) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = [tuple(r) for r in op1_fingerprints.near_pairs(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_edited_texts(docs, corpus):
    order = sorted(corpus, reverse=True)
    want = {}
    for i, (d, t) in enumerate(order):
        nxt, k = order[(i + 1) % len(order)][1], len(t) // 3
        want[d] = hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
    got = op1_fingerprints.compared(docs).collect()
    assert {r.doc_id: r.edited_sha256 for r in got} == want
    fp = {r.doc_id: r.fp for r in got}
    ids = [d for d, _ in order]
    assert all(r.next_fp == fp[ids[(ids.index(r.doc_id) + 1) % len(ids)]] for r in got)


def test_substring_removal(docs, corpus):
    first, want = {}, {}
    for d, t in corpus:
        w = t.split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for d, t in corpus:
        w = t.split()
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        want[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in op3_substring_dedup.deduplicated(docs).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_substring_removal_of_periodic_texts_and_repeated_ids(spark, seed):
    rng = random.Random(seed)
    phrases = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 30))) for _ in range(6)]
    rows = []
    for d in range(120):
        text = " ".join(rng.choice(phrases) if rng.random() < 0.5 else " ".join(rng.choice(["x", "y", f"q{rng.randrange(40)}"]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 20)))
        rows.append((d // 2 if d > 100 else d, (rng.choice(phrases) + " ") * rng.randrange(1, 12) if rng.random() < 0.2 else text))
    first, want = {}, []
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(d, first.get(k, d))
    for d, t in rows:
        w = t.split()
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        want.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in op3_substring_dedup.deduplicated(df).collect()) == sorted(want)


def test_repeats_double_until_none_survive(docs):
    sizes = {r["size"] for r in op3_substring_dedup.repeats(docs).collect()}
    assert 13 in sizes and 26 in sizes


def test_base_spans_as_plain_regexes():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(["1", "23", "4111111111111111", ".", "@", "a", "b-c", " ", "+", "(", "é", "-", "1.2.3.4", "x@y.z"]) for _ in range(rng.randrange(1, 25)))
        digits = lambda s: re.sub("[^0-9]", "", s)
        want = {
            "email": [m.span() for m in email.finditer(t)],
            "ip": [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))],
            "card": [m.span() for m in card.finditer(t) if 16 <= len(digits(m.group())) <= 19 and op2_pii.luhn(digits(m.group()))],
            "phone": [m.span() for m in phone.finditer(t) if 8 <= len(digits(m.group())) <= 15],
        }
        assert op2_pii.base_spans(t) == want, t


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    emit, step = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3))
    lengths = np.array([4, 2, 3])
    got = op2_pii.viterbi(emit, step, lengths)
    from itertools import product

    for b, n in enumerate(lengths):
        best = max(product(range(3), repeat=int(n)), key=lambda p: sum(emit[b, i, s] for i, s in enumerate(p)) + sum(step[a, c] for a, c in zip(p, p[1:])))
        assert tuple(got[b, :n]) == best


def test_crf_finds_held_out_spans_and_leaves_clean_text():
    weights = op2_pii.model()
    rows = [(t, s) for t, s in op2_pii.labelled_rows(4, seed=99) if not s or s[0][2] != "card"]
    found = wanted = wrong = 0
    for (_, spans), (base, added) in zip(rows, op2_pii.find([t for t, _ in rows], weights)):
        got = {(a, b, k) for k in op2_pii.KINDS for a, b in base[k] + added[k]}
        found, wanted, wrong = found + len(got & set(spans)), wanted + len(spans), wrong + len(got - set(spans))
    assert found / wanted > 0.9 and wrong / len(rows) < 0.05
    clean = [prose(200) for _ in range(20)]
    assert not any(a[k] for _, a in op2_pii.find(clean, weights) for k in a)


@pytest.mark.parametrize("before", [0, 300, 385, 395, 400, 405, 460])
def test_crf_spans_at_any_place_of_a_long_stretch(before):
    text = "1 2 " * (before // 2) + "write to stone (AT) river (DOT) com for moon" + " 3 4" * 300
    [(_, added)] = op2_pii.find([text], op2_pii.model())
    assert [text[a:b] for a, b in added["email"]] == ["stone (AT) river (DOT) com"]


def test_licences(spark):
    texts = ["x Licensed under the Apache License, Version 2.0. y", "CC-BY and cc by", "the GNU General Public License is", "nothing here", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in op4_licenses.scan(docs, op4_licenses.frequencies(docs)).collect()}
    assert got[0].labels == "apache-2.0" and got[0].base_labels == "" and got[0].n_words == 10  # "2.0" is two words
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (2, 0, 3, "cc-by")
    assert (got[2].base_labels, got[2].first_word) == ("gpl", 2)
    assert (got[3].labels, got[3].score, got[3].first_word) == ("", 0.0, None)
    assert got[4].labels == "mit" and got[4].score > 0.9


def test_every_phrase_passes_the_gate(spark):
    for phrases in [[p] for p, _ in op4_licenses.PHRASES] + [p for _, _, p in op4_licenses.TEMPLATES]:
        assert any(k in w for k in op4_licenses.KEYS for p in phrases for w in p.split())
    texts = ["Creative Commons Attribution 4.0 International", "a licensed Creative Commons Attribution 4.0 International", "BSD 3-Clause"] + ["this work is licensed under the terms of a license"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score > 0.5) for r in op4_licenses.scan(docs, op4_licenses.frequencies(docs)).collect()}
    assert got[0] == got[1] == ("cc-by", True) and got[2] == ("bsd", True)


def test_licence_phrases_in_random_texts(spark):
    rng = random.Random(8)
    parts = ["cc", "by", "CC-BY", "general", "public", "license", "General Public License", "all", "rights", "reserved", "x\u00e9", "All rights\nreserved", ".", "\u2014", "1"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "-", "\n", ", "]) for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in op4_licenses.scan(docs, op4_licenses.frequencies(docs)).collect()}
    for d, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
        at = [(i, label) for p, label in op4_licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        first, last = (min(at)[0], max(at)[0]) if at else (None, None)
        base = {label for _, label in at}
        assert (got[d].n_words, got[d].n_base, got[d].first_word, got[d].last_word, got[d].base_labels) == (len(w), len(at), first, last, ",".join(sorted(base)))
        assert base <= set(got[d].labels.split(","))


def test_quality_ranks_held_out_pairs():
    good = [prose(80).encode() for _ in range(60)]
    bad = [(" ".join(w.upper() + "!!" for w in prose(80).split())).encode() for _ in range(60)]
    x = np.array([op5_quality.features(t) for t in good + bad])
    y = np.array([1] * 60 + [0] * 60)
    part = np.arange(120) % 2 == 0
    s = op5_quality.score(op5_quality.train(x[part], y[part], 5000), x[~part])
    assert s[y[~part] == 1].min() >= op5_quality.CUT > s[y[~part] == 0].max()


def test_reparameterised_questions(spark):
    item = "A train leaves Paris for Lyon at 8 and covers 450 km while another leaves Lyon for Paris at 9 covering 300 km"
    same = "intro text. A train leaves Rome for Milan at 7 and covers 520 km while another leaves Milan for Rome at 10 covering 200 km and more"
    mixed = "A train leaves Rome for Milan at 7 and covers 520 km while another leaves Turin for Genoa at 10 covering 200 km"
    docs = spark.createDataFrame([(1, same), (2, mixed), (3, prose(80)), (4, item.lower())], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r.agreement for r in op6_decontaminate.leaks(docs, bench, agree=0.0).collect()}
    assert got[1] == 1.0 and got[2] < 1.0 and 3 not in got and got[4] == 1.0
    assert {r.doc_id for r in op6_decontaminate.leaks(docs, bench).collect()} == {1, 4}
    assert {r.doc_id for r in op6_decontaminate.leaks(docs, bench, agree=0.9).collect()} >= {1}
    assert 2 not in {r.doc_id for r in op6_decontaminate.leaks(docs, bench, agree=0.9).collect()}


def test_verbatim_after_a_mixed_copy_and_items_of_values(spark):
    item = "A train leaves Paris for Lyon at 8 and covers 450 km while another leaves Lyon for Paris at 9 covering 300 km"
    mixed = "A train leaves Rome for Milan at 7 and covers 520 km while another leaves Turin for Genoa at 10 covering 200 km"
    table = "12 plus 30 is 42 and 7 31 55 18 90 64 23 11 8 5"
    other = "12 plus 31 is 43 and 8 32 56 19 91 65 24 12 9 6"
    docs = spark.createDataFrame([(1, f"{mixed}. {item}."), (2, mixed), (3, f"see {table} there"), (4, f"see {other} there"), (5, "9 1 2 3 4 5 6 7 8 9 10")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "11 22 33 44 55 66 77 88 99 10"), (9, table)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in op6_decontaminate.leaks(docs, bench, agree=0.9).collect()}
    assert (1, 7) in got and (2, 7) not in got and not any(i == 8 for _, i in got)
    docs = spark.createDataFrame([(1, "x 11 22 33 44 55 66 77 88 99 10 y"), (2, "x 12 22 34 44 56 66 78 88 98 10 y")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in op6_decontaminate.leaks(docs, bench).collect()} == {(1, 8)}


def test_targets(spark):
    sizes = {"a": 100, "b": 10, "c": 1000, None: 50}
    got = {r.source: r.target for r in op7_source_mix.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights, left, want = {"a": 3, "b": 1, "c": 2, None: 3}, dict(sizes), {}
    total = 1.5 * sum(sizes.values())
    while True:
        rate = (total - sum(want.values())) / sum(weights[s] for s in left)
        over = [s for s in left if rate * weights[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            del left[s]
    want |= {s: rate * weights[s] for s in left}
    assert got == pytest.approx(want)


def test_pseudo_likelihood_word_by_word(docs, corpus, monkeypatch):
    monkeypatch.setattr(op10_masked_lm, "VOCABULARY", 20)
    vocab = op10_masked_lm.vocabulary(docs, 20)
    net = op10_masked_lm.train_round(op10_masked_lm.units(docs), op10_masked_lm.start(vocab), vocab, 0, 1)
    got = {r.doc_id: (r.n_words, r.log_likelihood) for r in op10_masked_lm.scored(docs, net, vocab).collect()}
    size, counted = vocab["size"], {}
    number = lambda w: int(op10_masked_lm.numbered(op3_substring_dedup.word_hashes([w])[0], vocab)[0][0])
    for _, t in corpus:
        for w in t.lower().split():
            counted[w] = counted.get(w, 0) + 1
    least = sorted(counted.values())[-20]
    assert all(number(w.encode()) < size for w, n in counted.items() if n > least) and sum(number(w.encode()) < size for w in counted) == 20
    assert vocab["mass"].sum() == pytest.approx(sum(counted.values()), rel=0.05)
    for d, t in corpus[::7]:
        ids, entry = (x.tolist() for x in op10_masked_lm.numbered(op3_substring_dedup.word_hashes([t.lower().encode()])[0], vocab))
        total = 0.0
        for i, w in enumerate(ids):
            h = np.tanh(sum(net["e"][j][entry[i + k] if 0 <= i + k < len(ids) else size + op10_masked_lm.OTHERS] for j, k in enumerate(op10_masked_lm.NEAR)))
            z = h @ net["w"] + net["b"]
            total += z[vocab["class"][w]] - np.log(np.exp(z).sum())
            if w < size:
                mates = [x for x in range(size) if vocab["class"][x] == vocab["class"][w]]
                z = [h @ net["u"][x] + vocab["inside"][x] for x in mates]
                total += z[mates.index(w)] - np.log(np.exp(z).sum())
            else:
                total += vocab["inside"][w]
        assert got[d][0] == len(ids) and got[d][1] == pytest.approx(total, abs=0.02)


def test_word_probabilities_sum_to_one(docs, corpus):
    vocab = op10_masked_lm.vocabulary(docs, 20)
    distinct = {w for _, t in corpus for w in t.lower().encode().split()}
    net, (ids, entry) = op10_masked_lm.start(vocab), op10_masked_lm.numbered(op3_substring_dedup.word_hashes(sorted(distinct))[0], vocab)
    around = np.repeat(op10_masked_lm.contexts(entry[:5], np.zeros(5, int), vocab["size"])[2:3], len(ids), 0)
    empty = set(range(len(vocab["mass"]))) - set(vocab["class"][ids].tolist())
    h = op10_masked_lm.hidden(net, around[:1])
    z, _ = op10_masked_lm._exp(net["w"].T @ h + net["b"][:, None])
    z = z[:, 0] / z.sum()
    assert np.exp(op10_masked_lm.log_likelihoods(net, vocab, around, ids)).sum() == pytest.approx(1 - sum(z[c] for c in empty), abs=1e-3)


def test_training_helps_and_partitions_do_not_matter(docs):
    vocab = op10_masked_lm.vocabulary(docs)
    before = op10_masked_lm.scored(docs, op10_masked_lm.start(vocab), vocab).agg({"log_likelihood": "sum"}).first()[0]
    rows = []
    for other in (docs, docs.repartition(3, "text")):
        got = op10_masked_lm.scored(other, *op10_masked_lm.fit(other))
        rows.append(sorted((r.doc_id, r.log_likelihood) for r in got.collect()))
    assert rows[0] == rows[1] and sum(x for _, x in rows[0]) > before


def test_every_word_is_trained_on(spark):
    texts = [" ".join(f"w{d}x{i}" for i in range(64)) for d in range(3)]
    net, vocab = op10_masked_lm.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2))
    before = op10_masked_lm.start(vocab)
    for j, k in enumerate(op10_masked_lm.NEAR):
        moved = np.abs(net["e"][j] - before["e"][j]).max(1) > 1e-6
        for t in texts:
            _, ids = op10_masked_lm.numbered(op3_substring_dedup.word_hashes([t.encode()])[0], vocab)
            assert all(moved[ids[i + k]] for i in range(len(ids)) if 0 <= i + k < len(ids))


@pytest.mark.parametrize("most", [5, 4096])
def test_shard_trees_give_the_nearest(most):
    import pyarrow as pa

    rng = random.Random(8)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    rows = [(c, 100 * c + i, seeds[rng.randrange(4)] ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1) for c in range(3) for i in range(40)]
    cols = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] - (r[2] >> 63 << 64) for r in rows])]
    batch = pa.RecordBatch.from_arrays(cols, names=["c", "sid", "fp"])
    got = [x for b in op9_simhash_dedup._nearest(11, most)(iter([batch.slice(0, 50), batch.slice(50)])) for x in zip(*(c.to_pylist() for c in b.columns))]
    fp = {sid: (c, x) for c, sid, x in rows}
    assert got and all(a > b and fp[a][0] == fp[b][0] and (fp[a][1] ^ fp[b][1]).bit_count() <= 11 for a, b in got)
    if most > len(rows):
        for c, sid, x in rows:
            want = min(((x ^ y).bit_count() for s, (d, y) in fp.items() if d == c and s < sid), default=64)
            assert [(x ^ fp[b][1]).bit_count() for a, b in got if a == sid] == ([want] if want <= 11 else [])


def test_near_copies_without_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for n, copies in ((150, 300), (90, 60), (20, 40)):  # no unedited text is among the copies
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(copies):
            t = list(base)
            for i in rng.sample(range(n), rng.randrange(1, 6)):
                t[i] = rng.choice(words) if rng.random() < 0.3 else f"x{rng.random()}"
            texts.append(" ".join(t[: rng.randrange(n - 8, n + 1)]) if rng.random() < 0.3 else " ".join(t + [f"y{rng.random()}"] * rng.randrange(3)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for t in texts for w in [t.split()]]
    low = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if low[a] != low[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = max(low[a], low[b]), min(low[a], low[b])
                low = [y if v == x else v for v in low]
    made, plain = [], op9_simhash_dedup.materialise

    def counted(df, label):
        out = plain(df, label)
        made.append(out.count() if label == "set-pairs" else 0)
        return out

    monkeypatch.setattr(op9_simhash_dedup, "materialise", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows, label = op9_simhash_dedup.similar(df)
    of = {r.doc_id: r.root for r in rows.join(label, "sid", "left").selectExpr("doc_id", "coalesce(root, sid) as root").collect()}
    first = {}
    for d in sorted(of):
        first.setdefault(of[d], d)
    assert [first[of[d]] for d in range(len(texts))] == low and 50 < len(set(low)) < len(texts)
    assert sum(made) < 3 * len(texts)


def test_alike_sizes_share_a_cell(spark):
    rows = [(h, n, n, 0, n) for h in (1, 2) for n in (*range(1, 300), *(5 * 4**k for k in range(4, 9)), *(4 * 4**k for k in range(4, 9))) if h == 1 or n > 30]
    got = {}
    for r in op9_simhash_dedup._cells(spark.createDataFrame(rows, "h long, sid long, n int, i int, r long").repartition(3)).collect():
        got.setdefault((r.h, r.sid), set()).add(r.g)
    met = {(x, y) for x in got for y in got if x < y and got[x] & got[y]}
    assert {((h, n), (g, m)) for h, n, *_ in rows for g, m, *_ in rows if h == g and n < m <= 1.25 * n} <= {(x, y) for x, y in met if x[0] == y[0]}
    assert not any(y[1] > 1.6 * x[1] for x, y in met if x[0] == y[0])


@pytest.mark.parametrize("near", [11, -1])  # -1: trees find nothing
def test_one_passage_in_texts_of_many_sizes(spark, monkeypatch, near):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(30)]
    texts = [passage + [word() for _ in range(int(40 * 1.1**k))] for k in range(36)]
    for k in (3, 9, 17, 25):
        texts += [texts[k][: -len(texts[k]) // 6], [w if rng.random() < 0.985 else word() for w in texts[k]], texts[k][: -len(texts[k]) // 3]]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    low = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if low[a] != low[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = max(low[a], low[b]), min(low[a], low[b])
                low = [y if v == x else v for v in low]
    made, plain = {}, op9_simhash_dedup.materialise

    def counted(df, label):
        out = plain(df, label)
        made[label] = made.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(op9_simhash_dedup, "materialise", counted)
    monkeypatch.setattr(op9_simhash_dedup, "NEAR", near)
    monkeypatch.setattr(op9_simhash_dedup, "COMMON", 0)  # the passage counts as rare
    df = spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in op9_simhash_dedup.keep_dissimilar(df).collect()) == sorted(set(low)) and len(set(low)) < len(texts) - 4
    assert 2 * made.get("set-centres", 0) < len(texts) and made["set-full"] < len(texts)  # few are made again whole
