"""Cases of the third round's findings: results that grow, sums at a limit."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnwell.operators import evals as E
from tarnwell.operators import retrieval as R
from tarnwell.operators import trace as TR
from tarnwell.plans import _registry, streams
from tarnwell.streaming import metrics


def test_complete_streams_are_written_by_executors(spark, tmp_path):
    for n, at in enumerate(("2024-01-01 00:00:00", "2024-01-01 00:20:00", "2024-01-01 02:00:00")):
        spark.createDataFrame([(7, at)], "user_id long, ts string").selectExpr("user_id", "cast(ts as timestamp) as ts").coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    got = streams.drained(metrics.sessions(metrics.timed(stream), "user_id"), "complete")
    assert got.inputFiles()  # a table in files, none in the driver's memory
    assert sorted(r.events for r in got.collect()) == [1, 2]


def test_crossing_of_unrounded_sums(spark):
    rows = [(1, 0.1), (2, 0.2), (3, 0.3)]  # the first two are 0.30000000000000004, as in the SQL
    con = duckdb.connect()
    con.execute("create table e as select * from (values (1, 0.1::double), (2, 0.2::double), (3, 0.3::double)) t(n, v)")
    want = con.execute("select n, round(used, 4), used > 0.3::double and used - v <= 0.3::double from (select *, sum(v) over (order by n) as used from e) order by n").fetchall()
    got = TR.budget_use(spark.createDataFrame(rows, "n int, v double").selectExpr("1 as run", "n", "v"), "run", ["n"], "v", 0.3)
    assert [(r.n, r.used, r.crossed) for r in got.orderBy("n").collect()] == want


@pytest.mark.parametrize("skip", [True, False])
def test_dense_by_blocks(spark, monkeypatch, skip):
    """Blocks of few rows, equal vectors in many of them, against every pair compared in Python."""
    monkeypatch.setattr(R, "BLOCK", 16)
    vectors = {i: [float(i * 7 % 5 - 2), float(i % 3), 0.1 * (i % 4)] for i in range(90)}
    v = spark.createDataFrame([*vectors.items(), (200, [0.0, 0.0, 0.0])], "id long, v array<double>")
    got = R.dense(v.filter("id % 3 = 0"), v, "id", "id", "v", 4, skip_self=skip)
    assert "NestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()  # no row for each pair
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in vectors.items() if any(v)}
    want = []
    for q in (i for i in unit if i % 3 == 0):
        scores = sorted((-round(sum(x * y for x, y in zip(unit[q], unit[i])), 9), i) for i in unit if not (skip and i == q))
        want += [(q, i, n) for n, (s, i) in enumerate([x for x in scores if -x[0] >= 0][:4], 1)]
    assert sorted((r.query_id, r.id, r["rank"]) for r in got.collect()) == sorted(want)


def test_metrics_without_listing_gains(spark):
    results = spark.createDataFrame([("c", "a", 1), ("c", "x", 2), ("c", "b", 3)], "case_id string, item_id string, rank int")
    gains = spark.createDataFrame([("c", i, 1.0) for i in "abdefg"], "case_id string, item_id string, gain double")
    ideal = spark.createDataFrame([("c", 6)], "case_id string, relevant int").withColumn("idcg", E.equal_ideal(F.col("relevant"), 3))
    listed = E.retrieval_metrics(results, gains, gains.select("case_id"), 3).collect()
    assert E.retrieval_metrics(results, gains.filter("item_id < 'c'"), gains.select("case_id"), 3, ideal=ideal).collect() == listed


def test_terms_are_counted_within_a_document(spark):
    texts = {1: "b a b, B c", 2: "", 3: "a", 4: None, 5: "...", 6: "É é e"}
    posts, stats = R.postings(spark.createDataFrame([*texts.items()], "d int, t string"), "d", "t")
    assert "Aggregate" not in posts._jdf.queryExecution().executedPlan().toString()  # no task gathers many documents' terms
    assert sorted(map(tuple, posts.select("d", "term", "tf", "dl").collect())) == [(1, "a", 1, 5), (1, "b", 3, 5), (1, "c", 1, 5), (3, "a", 1, 1), (6, "e", 1, 3), (6, "é", 2, 3)]
    assert stats.first().n == 6


def test_tasks_of_scores_grow_with_their_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b " + "c " * (i % 3)) for i in range(60)], "d int, t string")
    queries = spark.createDataFrame([(q, "a b c") for q in range(5)], "q int, t string")
    whole = sorted(map(tuple, R.bm25_scores(queries, docs, "q", "d", "t").collect()))
    monkeypatch.setattr(R, "PARTS", 50)
    scores = R.bm25_scores(queries, docs, "q", "d", "t")
    assert scores.rdd.getNumPartitions() == (60 * 2 + 40) * 5 // 50 and sorted(map(tuple, scores.collect())) == whole


def test_rows_are_dealt_to_more_tasks_the_more_there_are(spark, monkeypatch):
    monkeypatch.setattr(_registry, "PIECE", 10_000)
    assert _registry.texts(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 20
