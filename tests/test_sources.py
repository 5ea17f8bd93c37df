"""JSON lines, rotated traces, snapshots and streams over files."""

import json

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import redaction
from tarnwell.sources import jsonl as J
from tarnwell.sources import snapshots as SN
from tarnwell.streaming import metrics, stateful


def test_conversation_lines(spark, tmp_path):
    m = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], "conv_id long, turn long, role string, text string")
    J.append_messages(m, str(tmp_path / "c"))
    J.append_messages(m.withColumn("turn", F.col("turn") + 2), str(tmp_path / "c"))
    (tmp_path / "c" / "bad.json").write_text('\n  \n{"conv_id": 1, \nnull\n[1]\n')
    read = J.rows(spark, J.CONVERSATION, str(tmp_path / "c"))
    assert J.good(read).count() == 4 and J.skipped(read).first().skipped_lines == 3


def test_rotated_trace(spark, tmp_path):
    for name, run in (("t.jsonl", "new"), ("t.jsonl.1", "old"), ("t.jsonl.2", "oldest")):
        lines = [json.dumps({"type": "verifier.evaluated", "run": run, "ts": 1.5, "verifier": "v", "verdict": {"type": "pass"}}), json.dumps({"type": "retrieval.round", "run": run, "ts": 2, "verdict": "sufficient"}), json.dumps({"type": "what", "run": run, "ts": 3}), "broken"]
        (tmp_path / name).write_text("\n".join(lines))
    read = J.rotated(spark, str(tmp_path / "t.jsonl"))
    assert J.skipped(read).first().skipped_lines == 3
    ok = J.good(read).orderBy(F.desc("generation"), "ts").collect()
    assert [r.run for r in ok[::3]] == ["oldest", "old", "new"]
    assert [r.verdict_type for r in ok[:3]] == ["pass", "sufficient", None]
    assert J.of_run(J.good(read), "old").count() == 3


def test_trace_redaction(spark):
    line = json.dumps({"type": "info", "run": "r", "ts": 1, "message": "mail a@b.org", "payload": {"x@y.org": "c@d.org"}})
    got = spark.createDataFrame([(line,), ("{",)], "v string").select(J.redact_trace(F.col("v"), redaction.COMMON).alias("v")).collect()
    assert "@" not in got[0].v and json.loads(got[0].v)["type"] == "info"
    assert json.loads(got[1].v)["type"] == "trace.redaction_failed"


def test_redacted_traces_keep_types(spark):
    line = '{"type":"a@b.co","run":"r","n":3,"x":1.5,"ok":true,"none":null,"deep":{"list":["c@d.org",7,{"mode":"e@f.org","text":"e@f.org"}]},"payload":{"g@h.org":"i@j.org","type":"k@l.org"}}'
    got = spark.createDataFrame([(line,), (None,), ("[1]",)], "v string").select(J.redact_trace(F.col("v"), redaction.COMMON).alias("v")).collect()
    mask = "⟨email⟩"
    assert json.loads(got[0].v) == {"type": "a@b.co", "run": "r", "n": 3, "x": 1.5, "ok": True, "none": None, "deep": {"list": [mask, 7, {"mode": "e@f.org", "text": mask}]}, "payload": {mask: mask, "type": mask}}
    assert all(json.loads(g.v)["type"] == "trace.redaction_failed" for g in got[1:])


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    assert SN.load(spark, path, "a int").count() == 0
    SN.save(spark.createDataFrame([(1,)], "a int"), path)
    SN.save(SN.load(spark, path, "a int").union(spark.createDataFrame([(2,)], "a int")), path)
    assert {r.a for r in SN.load(spark, path, "a int").collect()} == {1, 2}
    (tmp_path / "s" / "version_9").mkdir()  # never completed
    assert SN.load(spark, path, "a int").count() == 2
    spark.createDataFrame([(1, 7)], "a int, _schema_version int").write.parquet(f"{path}/version_10")
    with pytest.raises(Exception, match="unsupported"):
        SN.load(spark, path, "a int").collect()


def test_baseline_report(spark):
    r = spark.createDataFrame([("x", 5)], "run_id string, elapsed_ns long")
    assert SN.for_baseline(r).first() == ("", 0)
    assert SN.report_lines(r).first().value == '{"elapsed_ns":5,"run_id":"x"}'


def test_stream_fan_out(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    each = metrics.fan_out([lambda b, n: seen.append(("a", b.count())), lambda b, n: seen.append(("b", b.count()))])
    stream.writeStream.foreachBatch(each).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert set(seen) == {("a", 5), ("b", 5)}


def test_breaker_steps():
    s = ("closed", 0, 0.0)
    for at, bad in ((0, True), (1, True)):
        s = stateful.advance(s, at, bad, 2, 10)
    assert s[0] == "open" and stateful.advance(s, 20, True, 2, 10)[0] == "open" and stateful.advance(s, 20, False, 2, 10)[0] == "closed"
