"""The pipeline over the smallest tables, each stage against a plain Python version that takes its own input."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as P
from tarnwell.llm import op2_pii, op5_quality, op6_decontaminate
from tarnwell.llm._common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Name of each stage, its input rows and its output rows."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in P.STAGES:
        got = stage(spark, docs, SF)
        got = spark.createDataFrame(got.collect(), got.schema)
        out.append((name, [r.asDict() for r in docs.collect()], [r.asDict() for r in got.collect()], got.columns))
        docs = got
    return {name: x for name, *x in out}


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_stages_keep_the_columns(stages, spark):
    want = table(spark, SF, "documents").columns
    assert all(columns == want for _, _, columns in list(stages.values())[:-1])
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontaminate", "personal_data", "mix"]


def test_quality(stages, spark):
    before, after, _ = stages["quality"]
    model = op5_quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    x = np.array([op5_quality.features((r["text"] or "").encode()) for r in before])
    z = np.clip((x - model["mean"]) / model["spread"], -8, 8) @ model["w"]
    assert ids(after) == sorted(r["doc_id"] for r, s in zip(before, z) if s >= model["cut"] - 1e-9)
    assert all(r in before for r in after)


def test_near_duplicates(stages):
    before, after, _ = stages["near_duplicates"]
    words = {r["doc_id"]: [w for w in re.split(r"[ \t-\r]+", (r["text"] or "").encode().lower().decode()) if w] for r in before}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))} for d, w in words.items()}
    low = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and low[a] != low[b]:
                x, y = min(low[a], low[b]), max(low[a], low[b])
                low = {d: x if v == y else v for d, v in low.items()}
    assert ids(after) == sorted(set(low.values()))


def canon(text, names=True):
    raw = [x for x in re.split(op6_decontaminate.BETWEEN, text) if x.strip(op6_decontaminate.ENDS)]
    plain = [x.strip(op6_decontaminate.ENDS) for x in raw]
    out = []
    for i, x in enumerate(plain):
        number = "0" <= x[0] <= "9"
        begins = i == 0 or raw[i - 1][-1] in op6_decontaminate.ENDS or (x == x.upper() and len(x) > 1)
        if number:
            out.append("#n")
        elif x.lower() != x:
            out.append(x.lower() if begins or not names else "#name")
        elif x in op6_decontaminate.UNITS and i and "0" <= plain[i - 1][0] <= "9":
            out.append("#u")
        else:
            out.append(x)
    return (plain, out) if not names else (plain, out, canon(text, False)[1])


def leaked(text, items):
    plain, made, _ = canon(text or "")
    for iplain, icanon, ilow in items:
        w = min(len(icanon), op6_decontaminate.WINDOW)
        at = defaultdict(list)
        for i in range(len(icanon) - w + 1):
            window = tuple(icanon[i : i + w])
            if sum(not t.startswith("#") for t in window) * 2 > w:
                at[window].append(i)
                at[tuple(ilow[i : i + w])].append(i)
        of, shifts = len({i for x in at.values() for i in x}), defaultdict(set)
        for p in range(len(made) - w + 1):
            for i in at.get(tuple(made[p : p + w]), []):
                shifts[p - i].add(i)
        if not shifts:
            continue
        shift = max(shifts, key=lambda s: (len(shifts[s]), -s))
        if len(shifts[shift]) < of * op6_decontaminate.COVER:
            continue
        slots = {(iplain[i].lower(), plain[i + shift].lower()) for i, t in enumerate(icanon) if t.startswith("#") and 0 <= i + shift < len(plain)}
        if not slots or round(len({a for a, _ in slots}) / len(slots), 6) >= op6_decontaminate.AGREE:
            return True
    return False


def test_decontamination(stages, spark):
    before, after, _ = stages["decontaminate"]
    items = [canon(r.text) for r in table(spark, SF, "benchmark").collect()]
    items = [x for x in items if len(x[0]) >= op6_decontaminate.SHORTEST]
    assert ids(after) == sorted(r["doc_id"] for r in before if not leaked(r["text"], items))


def test_decontamination_of_all_documents(spark):
    items = [canon(r.text) for r in table(spark, SF, "benchmark").collect()]
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = {r.doc_id for r in docs.collect() if leaked(r.text, items)}
    assert want and {r.doc_id for r in op6_decontaminate.leaks(docs, bench).collect()} == want


def test_personal_data(stages):
    before, after, _ = stages["personal_data"]
    by = {r["doc_id"]: r for r in after}
    assert ids(before) == ids(after)
    for r in before:
        [(base, added)] = op2_pii.find([r["text"]], op2_pii.model())
        text, end = r["text"] or "", 0
        out = ""
        for s, e, k in sorted((s, e, k) for k in op2_pii.KINDS for s, e in base[k] + added[k]):
            if s >= end:
                out += text[end:s] + f"[{k.upper()}]"
            end = max(end, e)
        assert (by[r["doc_id"]]["text"] or "") == out + text[end:]


def test_mix(stages, spark):
    before, after, _ = stages["mix"]
    weight = {r.doc_id: 2.0 if r.quality else 0.5 for r in table(spark, SF, "labels").collect()}
    sizes, of = defaultdict(int), {}
    for r in before:
        of[r["doc_id"]] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += of[r["doc_id"]]
    named = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(named)}
    goal, left = {}, set(named)
    while left:
        rate = (1.5 * sum(sizes.values()) - sum(goal.values())) / sum(w[s] for s in left)
        over = [s for s in left if rate * w[s] >= 2 * sizes[s]]
        if not over:
            goal |= {s: rate * w[s] for s in left}
            break
        goal |= {s: 2.0 * sizes[s] for s in over}
        left -= set(over)
    got = {r["doc_id"]: r for r in after}
    assert sorted(got) == ids(before)
    for s in named:
        epochs = int(goal[s] // sizes[s]) if sizes[s] else 0
        rest, run = goal[s] - epochs * sizes[s], 0

        def key(d):
            u = (int(hashlib.md5(f"mix:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / weight.get(d, 1.0)

        for d in sorted((r["doc_id"] for r in before if r["source"] == s), key=key):
            taken = of[d] * (epochs + (run + of[d] / 2 <= rest))
            run += of[d]
            assert (got[d]["size"], got[d]["source_size"], got[d]["taken"]) == (of[d], sizes[s], taken)
            assert got[d]["target"] == pytest.approx(goal[s], abs=1e-5)


def test_run_gives_the_last_stage(stages, spark):
    got = {r.doc_id: r.taken for r in P.run(spark, SF).collect()}
    assert got == {r["doc_id"]: r["taken"] for r in stages["mix"][1]}
