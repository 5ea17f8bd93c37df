"""Every operator and pipeline stage over nulls, empty and long texts, ties, repeated rows, extra columns, no rows."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwell.llm import op1_fingerprints, op2_pii, op3_substring_dedup, op4_licenses, op5_quality, op6_decontaminate, op7_source_mix, op8_url_filter, op9_simhash_dedup, op10_masked_lm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, h long, row string"
LONG = "lorem ipsum dolor sit amet " * 3000


def rows():
    texts = [None, "", " \n\t ", "a", LONG, LONG, "mail me at a.b@c.org now", "All rights reserved. CC by 4.0", "ÉÀ ünï cödé 漢字 text " * 20]
    out = [(i, t, None, None if i % 3 else f"s{i % 2}", None, 1, 2, 3, "x") for i, t in enumerate(texts)]
    return [*out, out[4], out[3], (None, "a", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (6, "other text with the same id", "en", "s1", 5, 1, 1, 1, "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(None, 1, 0), (3, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (None, "x"), (2, ""), (3, "a"), (4, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet"), (4, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet")], "item_id long, text string")


def operators(labels, bench):
    return {
        "op1": lambda d: op1_fingerprints.compared(d),
        "op2": op2_pii.scan,
        "op3": op3_substring_dedup.deduplicated,
        "op4": lambda d: op4_licenses.scan(d, op4_licenses.frequencies(d)),
        "op5": lambda d: op5_quality.scored(d, op5_quality.fit(d, labels)),
        "op7": lambda d: op7_source_mix.mix(d),
        "op9": op9_simhash_dedup.classes,
        "op10": lambda d: op10_masked_lm.scored(d, *op10_masked_lm.fit(d)),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op7", "op9", "op10"])
def test_one_row_for_each_row(name, docs, labels, bench):
    got = operators(labels, bench)[name](docs).collect()
    assert len(got) == len(rows())
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows())


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op7", "op9", "op10"])
def test_no_rows(name, docs, labels, bench):
    assert operators(labels, bench)[name](docs.limit(0)).collect() == []


def test_equal_texts_equal_fingerprints(docs):
    got = [r.fp for r in op1_fingerprints.compared(docs).collect() if r.doc_id in (4, 5)]
    assert len(got) == 3 and len(set(got)) == 1
    assert {r.fp for r in op1_fingerprints.compared(docs).collect() if r.doc_id in (0, 1)} == {0}


def test_filters_keep_columns(docs, labels, bench):
    for kept in (op5_quality.keep_good(docs, labels), op9_simhash_dedup.keep_one(docs), op6_decontaminate.keep_clean(docs, bench), op2_pii.masked(docs)):
        assert kept.dtypes == docs.dtypes
        kept.collect()
    for stage in (lambda d: op5_quality.keep_good(d, labels), op9_simhash_dedup.keep_one, lambda d: op6_decontaminate.keep_clean(d, bench), op2_pii.masked):
        assert stage(docs.limit(0)).collect() == []
    assert op6_decontaminate.keep_clean(docs, bench.limit(0)).count() == docs.count()


def test_near_duplicates_one_of_each(docs):
    kept = [r.doc_id for r in op9_simhash_dedup.keep_one(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [0, 3, 4, 6, 6, 7, 8]))  # two classes have the id 6


def test_callers_columns_stay(spark):
    rows = [(1, "a b c", "mongo-1", 5, "k"), (2, "a b c", "mongo-2", 6, "l"), (3, "z", "mongo-3", 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _row long, _key0 string")
    for keep in (op9_simhash_dedup.keep_one, op9_simhash_dedup.keep_dissimilar):
        got = keep(df)
        assert got.dtypes == df.dtypes and sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2]]


def test_similar_texts_one_of_each(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(12)]
    shared = [rng.choice(words) for _ in range(20)]
    texts = [None, "", " ", "one two", "One  TWO", "one two three"] + [" ".join(b + shared) for b in base]
    for b in base:
        for edits in (1, 2, 3, 4) if b is not base[0] else (1, 2, 3, 4, 5, 6) * 8:
            t = list(b + shared)
            for i in rng.sample(range(len(t)), edits):
                t[i] = f"x{rng.random()}"
            texts.append(" ".join(t))
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))} for t in texts for w in [(t or "").lower().split()]]
    low = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and low[a] != low[b]:
                x, y = max(low[a], low[b]), min(low[a], low[b])
                low = [y if v == x else v for v in low]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted(r.doc_id for r in op9_simhash_dedup.keep_dissimilar(df).collect())
    assert got == sorted(set(low)) and len(got) < len(op9_simhash_dedup.keep_one(df).collect())
    none = df.limit(0)
    assert op9_simhash_dedup.keep_dissimilar(none).collect() == [] and op9_simhash_dedup.keep_dissimilar(none).dtypes == df.dtypes


def test_leaks(docs, bench):
    assert {(r.doc_id, r.item_id) for r in op6_decontaminate.leaks(docs, bench).collect()} == {(4, 4), (5, 4)}


def test_masking(docs):
    got = {r.doc_id: r.text for r in op2_pii.masked(docs).collect() if r.doc_id == 6 and "mail" in r.text}
    assert got == {6: "mail me at [EMAIL] now"}


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "no scheme", "x"), (3, "http://A.Example.NET/en/x?q", "y"), (4, "http://example.net", None), (5, "https://b.org/fr/#x", "!!"), (None, "x://m.example.com/de/", ""), (5, "https://b.org/fr/#x", "!!"), (7, "a://casino.example.org/x", "")], "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in op8_url_filter.judged(pages, op8_url_filter.page_outcomes(pages)).collect()), key=str)
    assert (3, "a.example.net", "/en/x", "example.net/en/", "allow") in got
    assert (4, "example.net", "", None, "allow") in got
    assert (0, "m.example.com", "/de/", "example.com/de/", "block") in got
    assert (1, "", "", None, "allow") in got and (2, "", "", None, "allow") in got
    assert len(got) == 8 and sum(r[0] == 5 for r in got) == 2
    assert op8_url_filter.judged(pages.limit(0), op8_url_filter.page_outcomes(pages.limit(0))).collect() == []


def test_mix_totals(docs):
    got = op7_source_mix.mix(docs).groupBy("source").agg(F.max("target").alias("t"), F.max("source_size").alias("s"), F.sum("taken").alias("n")).collect()
    assert abs(sum(r.t for r in got) - 1.5 * sum(r.s for r in got)) < 1e-3
    assert all(r.t <= 2 * r.s + 1e-6 for r in got)
