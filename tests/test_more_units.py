"""Archives, consolidation, templates, seams and stateful streams over small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import checks as C
from tarnwell.functions import text as T
from tarnwell.functions import verdicts as V
from tarnwell.operators import archive as A
from tarnwell.operators import consolidation as K
from tarnwell.operators import context as X
from tarnwell.operators import memory as M
from tarnwell.operators import retrieval as R
from tarnwell.operators import trace as TR
from tarnwell.sources import jsonl as J
from tarnwell.streaming import stateful

FACT = "id string, thread_id string, subject string, predicate string, text string, origin string, confidence double, importance int, tags array<string>, valid_from timestamp, valid_until timestamp, recorded_at timestamp, invalidated_at timestamp, expires_at timestamp, supersedes string, last_accessed_at timestamp, access_count int"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def day(n):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def fact(i, text, predicate="title", start=0, **more):
    row = {"id": i, "thread_id": "t", "subject": "user", "predicate": predicate, "text": text, "origin": "userStated", "confidence": 0.9, "importance": 5, "tags": [], "valid_from": day(start), "valid_until": None, "recorded_at": day(start), "invalidated_at": None, "expires_at": None, "supersedes": None, "last_accessed_at": day(start), "access_count": 0}
    return tuple((row | more).values())


@pytest.fixture(scope="module")
def messages(spark):
    rows = [("t", 0, "system", "hello"), ("t", 1, "user", "I live in Rome"), ("t", 2, "assistant", "Noted"), ("t", 3, "user", "thanks"), ("u", 0, "user", "hm")]
    return spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").withColumn("created_at", F.lit("2024-01-10 00:00:00").cast("timestamp"))


def test_rounds_and_ledger(spark, messages):
    got = A.archived_rounds(messages).collect()
    assert sorted((r.conv_id, r.ordinal, r.first_turn, r.last_turn) for r in got) == [("t", 0, 0, 0), ("t", 1, 1, 2), ("t", 2, 3, 3), ("u", 0, 0, 0)]
    assert next(r for r in got if r.ordinal == 1).display == "user: I live in Rome\nassistant: Noted"
    assert "\nRome" in next(r for r in got if r.ordinal == 1).index_text
    ledger = spark.createDataFrame([("t", 1, 7)], "conv_id string, first_turn int, ordinal int")
    again = {(r.conv_id, r.first_turn): r.ordinal for r in A.archived_rounds(messages, ledger).collect()}
    assert again == {("t", 0): 8, ("t", 1): 7, ("t", 3): 9, ("u", 0): 0}


def test_index_remove_is_as_never_indexed(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c")], "d int, text string")
    gone = A.index_remove(docs, docs.filter("d = 2"), "d")
    assert R.bm25(spark.createDataFrame([("q", "b c")], "q string, text string"), gone, "q", "d", "text", 5).collect() == R.bm25(spark.createDataFrame([("q", "b c")], "q string, text string"), docs.filter("d <> 2"), "q", "d", "text", 5).collect()
    up = A.index_upsert(docs, spark.createDataFrame([(2, "x"), (4, "y"), (4, "z")], "d int, text string"), "d")
    assert sorted(map(tuple, up.collect())) == [(1, "a b"), (2, "x"), (3, "c"), (4, "z")]


def test_removal_from_every_index(spark):
    index = spark.createDataFrame([("a",), ("b",)], "round_id string")
    ids = index.filter("round_id = 'a'")
    after, pending = A.remove_rounds({"lexical": index, "vector": index}, ids, "round_id", ("vector",))
    assert after["lexical"].count() == 1 and after["vector"].count() == 2 and [tuple(r) for r in pending.collect()] == [("vector", "a")]
    facts = spark.createDataFrame([fact("f", "x")], FACT)
    _, cleared = K.maintain(facts, after, pending, F.lit("2024-01-02 00:00:00").cast("timestamp"))
    assert cleared["vector"].count() == 1


def test_recall_stays_in_the_thread(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "gone", 3)], "q string, round_id string, rank int")
    rounds = spark.createDataFrame([("a", "other"), ("b", "t")], "round_id string, thread_id string")
    got = A.recalled(hits, rounds, "round_id", "thread_id", spark.createDataFrame([("q", "t")], "q string, thread_id string"), "q", 3).collect()
    assert [(r.round_id, r.rank) for r in got] == [("b", 1)]
    assert [r.round_id for r in A.orphans(hits, rounds, "round_id").collect()] == ["gone"]


def test_consolidation_supersedes(spark, messages):
    facts = spark.createDataFrame([fact("f", "Berlin", "location")], FACT)
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    after, decisions = K.consolidate(messages, facts, now)
    rows = {r.text: r for r in after.collect()}
    assert {(r.operation, r.rationale) for r in decisions.collect()} == {("update", "newerWins")}
    assert rows["Berlin"].invalidated_at is not None and rows["Berlin"].valid_until == day(9)
    assert rows["Rome"].supersedes == "f" and rows["Rome"].invalidated_at is None
    assert [tuple(r) for r in K.histogram(decisions).collect()] == [("update", "newerWins", 1)]
    kept = K.reroute(decisions, F.lit("noop")).first()
    assert (kept.operation, kept.rationale) == ("noop", "rerouted")
    assert K.reroute(decisions, F.lit("nonsense")).first().operation == "update"
    assert [r.id for r in K.options(K.claims(messages), facts, now).collect()] == ["f"]
    again, second = K.consolidate(messages, after, F.lit("2024-01-11 00:00:00").cast("timestamp"))
    assert {r.rationale for r in second.collect()} == {"duplicateOfCurrent"}
    assert {r.text: r.access_count for r in again.collect()} == {"Berlin": 0, "Rome": 1}


def test_chain_both_ways(spark):
    f = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", None)], "id string, supersedes string")
    assert sorted(map(tuple, M.chain(f, "b").collect()), key=lambda r: r[1]) == [("a", -1), ("b", 0), ("c", 1)]


def test_templates(spark):
    got = value(spark, X.render_template("a {{x}} b {{y}}", {"x": F.lit("1")}, {"y": "2"}))
    assert (got.text, got.error) == ("a 1 b 2", None)
    assert value(spark, X.render_template("{{x}}", {"x": F.lit(None).cast("string")})).error == "missing: x"
    assert value(spark, X.render_template("{{x}}", {"x": F.lit("{{y}}")})).error == "places are left"
    assert value(spark, X.render_template("k", {"z": F.lit("1")})).error == "unknown: z"
    t = spark.createDataFrame([("p", 1, "one"), ("p", 2, "two"), ("q", 1, "q1")], "name string, version int, body string")
    pins = spark.createDataFrame([("p", 1)], "name string, version int")
    wanted = spark.createDataFrame([("p", None), ("p", 2), ("q", None)], "name string, version int")
    assert sorted(r.body for r in X.resolve_templates(wanted, t, pins).collect()) == ["one", "q1", "two"]


def test_prompt_framing(spark):
    src = F.array(F.struct(F.lit("1").alias("id"), F.lit('a"b').alias("title"), F.lit("x < y & z").alias("content")))
    got = value(spark, R.render_prompt(F.lit("q"), src))
    assert 'title="a&quot;b"' in got and "x &lt; y &amp; z" in got
    talk = R.render_transcript(F.array(F.struct(F.lit("tool").alias("role"), F.lit("<x>").alias("content"), F.lit(None).cast("string").alias("tool"))), F.lit("(earlier 2 turn(s) omitted)"))
    none = F.array().cast("array<struct<id:string,title:string,content:string>>")
    want = 'Conversation so far:\n(earlier 2 turn(s) omitted)\n<message role="tool" tool="unknown">\n&lt;x>\n</message>\n\nUser question: q\nTreat fenced'
    assert value(spark, R.render_prompt(F.lit("q"), none, talk)).startswith(want)
    assert value(spark, R.render_prompt(F.lit("q"), F.array().cast("array<struct<id:string,title:string,content:string>>"))) == "q"


def test_small_texts(spark):
    assert value(spark, T.key_values([("a", F.lit("x  y")), ("b", F.lit("")), ("c", F.lit(3))])) == "a=x_y b=_ c=3"
    assert value(spark, T.first_line(F.lit("\n \n  hi there \nmore"))) == "hi there"
    assert value(spark, R.rewritten(F.lit("q"), F.lit("Same Query\nx"), F.lit("same  query"))) is None
    assert value(spark, T.truncate_utf8(F.lit("aéé"), 4)) == "aé"
    verdict = V.failed("repair", "v", "bad")
    assert "bad" in value(spark, X.repair_prompt(F.lit("p"), F.lit("o"), verdict)) and value(spark, X.repair_prompt(F.lit("p"), F.lit("o"), V.passed())) is None


def test_redirects_and_policies(spark):
    assert value(spark, C.redirect_problem(F.array(F.lit("https://a.example"), F.lit("https://10.0.0.1/"), F.lit("ftp://b")))) == "privateAddress"
    assert value(spark, C.first_denial(V.passed(), V.failed("reject", "b", "no"), V.failed("reject", "c", "no")))["diagnostic"]["verifier"] == "b"
    assert value(spark, C.scopes(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("c"))))["diagnostic"]["message"] == "missing: a, b"


def test_scorer_falls_back(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "bb", 2)], "q string, text string, rank int")
    best = lambda c: R.with_scorer(hits, c, "q", "text").orderBy("rank").select("text").collect()
    assert [r.text for r in best(lambda t: F.length(t))] == ["bb", "a"]
    assert [r.text for r in best(lambda t: F.when(t == "a", 1))] == ["a", "bb"]


def test_run_summary(spark):
    lines = [{"type": "run.started"}, {"type": "model.started"}, {"type": "tool.requested", "tool": "x"}, {"type": "tool.completed", "tool": "x", "success": False, "elapsed_ns": 5}, {"type": "verifier.evaluated", "verifier": "v", "verdict": {"type": "repair"}}, {"type": "repair.scheduled", "attempt": 1}, {"type": "budget.exhausted", "kind": "turns"}, {"type": "run.ended", "success": False}]
    df = spark.createDataFrame([(json.dumps(x | {"run": "r", "ts": float(i)}),) for i, x in enumerate(lines)], "v string").select(*J.trace_columns(F.col("v")))
    r = TR.run_summary(df).first()
    assert (r.success, r.turns, r.tool_calls, r.repairs, r.exhausted, r.started, r.ended) == (False, 1, 1, 1, "turns", 0.0, 7.0)
    t = TR.trace_metrics(df, "tool").first()
    assert (t.events, t.failed, t.elapsed_ns) == (2, 1, 5)
    assert TR.trace_metrics(df, "verifier").first().repair_verdicts == 1


def test_stalled_runs_and_thread_memory(spark, tmp_path):
    rows = [("t", "name", "Ann", day(1), False), ("t", "name", "Ann", day(2), False), ("t", "name", "Bea", day(3), False), ("t", "name", "Old", day(0), False), ("t", "name", "x", day(4), True), ("t", "city", "x", day(4), True)]
    schema = "thread_id string, slot string, text string, valid_from timestamp, retraction boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "c"))
    out = stateful.thread_memory(spark.readStream.schema(schema).parquet(str(tmp_path / "c")))
    out.writeStream.format("memory").queryName("thread_memory_test").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "k")).start().awaitTermination()
    got = sorted((r.slot, r.text, r.operation) for r in spark.table("thread_memory_test").collect())
    assert got == [("city", "x", "noop"), ("name", "Ann", "noop"), ("name", "Ann", "update"), ("name", "Bea", "update"), ("name", "Old", "add"), ("name", "x", "delete")]
    chunks = [("a", day(0), False), ("a", day(1), False), ("a", day(2), True), ("b", day(0), False)]
    spark.createDataFrame(chunks, "run string, at timestamp, done boolean").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("run string, at timestamp, done boolean").parquet(str(tmp_path / "s")).withWatermark("at", "1 second")
    stateful.stalled(stream, "run", "at", "done", 60, 30).writeStream.format("memory").queryName("stalled_test").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "z")).start().awaitTermination()
    assert sorted((r.run, r.chunks, r.reason) for r in spark.table("stalled_test").collect()) == [("a", 2, "finished"), ("b", 0, "firstToken")]


def test_best_of_n_variants(spark):
    rows = [("r", 0, 1.0, "repair"), ("r", 0, 3.0, "pass"), ("r", 1, 1.0, "pass"), ("r", 2, 9.0, "reject"), ("s", 0, 1.0, "reject"), ("s", 1, 1.0, "escalate")]
    checks = spark.createDataFrame(rows, "run_id string, candidate int, weight double, verdict string")
    from tarnwell.operators import evals as E

    got = {(r.run_id, r.candidate): (r.score, r.chosen) for r in E.best_of_n(checks).collect()}
    assert got == {("r", 0): (0.75, False), ("r", 1): (1.0, True), ("r", 2): (0.0, False), ("s", 0): (0.0, True), ("s", 1): (0.0, False)}
    assert [r.candidate for r in E.best_of_n(checks, first_pass=True).filter("chosen and run_id = 'r'").collect()] == [1]


def test_budget_projection(spark):
    use, most = {"turns": F.lit(8), "toolCalls": F.lit(3), "outputTokens": F.lit(10.0)}, {"turns": 8, "toolCalls": 4, "outputTokens": 20.0}
    assert value(spark, TR.exhausted(use, most)) == "turns"
    assert value(spark, TR.exhausted(use, most, "toolCalls")) is None
    assert value(spark, TR.exhausted(use, most, "turns")) == "turns"


def test_oversize_text_is_redacted_whole(spark):
    from tarnwell.functions import redaction

    assert value(spark, redaction.redact(F.lit("mail a@b.org"), limit=5)).startswith("⟨redacted")


def test_encoded_and_decomposed_paths(spark):
    paths = ["%2egit/config", "a/.s%73h/x", "a%zz", "plain.txt", "x/SECRET/y", "100%25/k.pem", None, "cafe\u0301/.env"]
    got = [r.p for r in spark.createDataFrame([(p,) for p in paths], "p string").select(C.denied_path(F.col("p")).alias("p")).collect()]
    assert [g is not None for g in got] == [True, True, False, False, True, True, False, True]


def test_chains_of_any_length_and_rings(spark):
    line = spark.createDataFrame([(f"{i:05d}", f"{i - 1:05d}" if i else None) for i in range(250)], "id string, supersedes string")
    assert {(r.id, r.step) for r in M.chain(line, "00100").collect()} == {(f"{i:05d}", i - 100) for i in range(250)}
    assert M.chain(line, "nothing").collect() == []
    ring = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b")], "id string, supersedes string")
    assert {(r.id, r.step) for r in M.chain(ring, "a").collect()} == {("a", 0), ("c", -1), ("b", -2), ("b", 1), ("c", 2)}
