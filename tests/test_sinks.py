from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from tests.test_rules import PASSWORD, blocks_of, feed_of
from tidegate import schemas, session
from tidegate.operators import reports as A
from tidegate.operators import rules as R
from tidegate.sources import readers, writers
from tidegate.streaming import jobs as J

LINES = [
    {"request_id": 1, "timestamp": "2024-01-01T10:00:00Z", "method": "get", "url": "https://bank.io/login", "req_headers": {"Content-Type": "text/html", "B": "2", "X-Agent-Name": "bot"}, "body": PASSWORD},
    {"request_id": 2, "timestamp": "2024-01-02T10:00:00Z", "method": "POST", "url": "http://plain.io/", "req_headers": {}, "body": "", "environment": "test", "agent_name": "a"},
    {"request_id": 3, "method": "GET", "url": "https://paypa1.com/", "req_headers": {}, "body": ""},
]


@pytest.fixture()
def log(tmp_path):
    folder = tmp_path / "traffic"
    folder.mkdir()
    for i, line in enumerate(LINES):
        (folder / f"{i}.json").write_text(json.dumps(line) + "\n" + ("{broken\n" if i == 0 else ""), encoding="utf-8")
    return str(folder)


KEEP = ("request_id", "url", "method", "timestamp", "environment", "agent_name", "session_id", "req_headers")


def test_traffic_source(spark, log):
    rows = readers.read_traffic(spark, log)
    broken = rows.filter("request_id is null").select("_corrupt_record").collect()
    assert [r[0] for r in broken] == ["{broken"]
    good = {r["request_id"]: r for r in rows.filter("request_id is not null").collect()}
    assert good[1]["agent_name"] == "bot" and good[2]["agent_name"] == "a"
    assert good[1]["environment"] == "prod" and good[3]["timestamp"] is not None
    named = {r["request_id"]: r["agent_name"] for r in readers.read_traffic(spark, log, agent_headers=("x-none", "B", "X-Agent-Name")).collect()}
    assert named[1] == "2" and named[2] == "a"


def test_binary_bodies(spark):
    rows = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xff\xfe\x00"),)], "b binary")
    assert [r[0] for r in rows.select(readers.text_or_size(F.col("b"))).collect()] == ["ok", "<3 bytes binary>"]


def test_audit_tables_and_log(spark, log, tmp_path):
    rows = readers.read_traffic(spark, log).filter("request_id is not null")
    scored = R.evaluate(rows, feed_of(spark), blocks_of(spark), keep=KEEP)
    out = str(tmp_path / "audit")
    writers.write_audit_tables(scored, out)
    events = spark.read.parquet(f"{out}/events")
    got = {r["event_id"]: r for r in events.collect()}
    assert [got[i]["guard_action"] for i in (1, 2, 3)] == ["Allow", "Block", "Block"]
    assert got[1]["headers_json"] == '{"B":"2","Content-Type":"text/html","X-Agent-Name":"bot"}' and got[1]["http_method"] == "GET"
    lines = readers.read_table(spark, f"{out}/rules_analysis", schemas.RULES_ANALYSIS)
    assert lines.count() == 27 and lines.select("analysis_id").distinct().count() == 27
    assert lines.filter("event_id = 2 and rule_score is null").count() == 7
    counts = {r["request_id"]: tuple(r)[1:] for r in R.rule_counts(scored).collect()}
    assert counts == {1: (9, 1), 2: (9, 1), 3: (9, 1)}
    writers.write_audit_log(writers.decision_records(scored), str(tmp_path / "log"))
    records = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "log")).collect()]
    first = next(r for r in records if r["event_id"] == 1)
    assert list(first) == sorted(first) and first["timestamp"] == "2024-01-01T10:00:00Z" and first["method"] == "GET"
    shown = A.event_shape(readers.with_headers(events), with_session=True).filter("event_id = 1").collect()[0]
    assert shown["headers"]["B"] == "2" and shown["timestamp"] == "2024-01-01T10:00:00Z"


def shuffled_columns(df):
    """Input columns of every exchange of a plan."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    blocks = re.findall(r"^\(\d+\) Exchange\s*\n(?:Input|Output) \[\d+\]: \[(.*)\]$", text, re.MULTILINE)
    return text, [re.sub(r"#\d+L?", "", c).strip() for block in blocks for c in block.split(",")]


def test_bodies_do_not_reach_a_shuffle(spark, log):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "5000", "spark.sql.debug.maxToStringFields": "500"}
    before = {k: spark.conf.get(k) for k in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        scored = R.evaluate(readers.read_traffic(spark, log), feed_of(spark), blocks_of(spark))
        text, columns = shuffled_columns(scored)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert "SortMergeJoin" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "host" in columns
    assert not {"body", "raw_body", "live_html", "tokens", "forms", "inputs", "hot_inputs"} & set(columns)


def test_stream_equals_batch(spark, log, tmp_path):
    rows = readers.read_traffic(spark, log).filter("request_id is not null")
    batch = writers.audit_analyses(R.evaluate(rows, feed_of(spark), blocks_of(spark), keep=KEEP))
    out = str(tmp_path / "stream")
    stream = J.read_traffic_stream(spark, log, max_files=1).filter("request_id is not null")
    J.write_stream(stream, out, str(tmp_path / "c"), feed=feed_of(spark), blocklist=blocks_of(spark)).awaitTermination()
    streamed = J.read_audit(spark, out, "rules_analysis")
    assert sorted(map(tuple, streamed.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    assert J.read_audit(spark, out, "log").count() == 3


def test_stream_attributes_sessions(spark, log, tmp_path):
    sessions = spark.createDataFrame(
        [(7, None, "2023-12-31", None, "prod", "bot"), (8, None, "2024-01-01", None, "test", "a")],
        "session_id long, user_id long, start_time string, end_time string, environment string, agent_name string",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("start_time", "end_time")})
    stream = J.read_traffic_stream(spark, log).filter("request_id is not null")
    out = str(tmp_path / "attributed")
    J.write_stream(stream, out, str(tmp_path / "c2"), sessions=sessions).awaitTermination()
    got = {r["event_id"]: r["session_id"] for r in J.read_audit(spark, out, "events").collect()}
    assert got == {1: 7, 2: 8}


def test_replayed_batch_leaves_no_duplicates(spark, log, tmp_path):
    rows = readers.read_traffic(spark, log).filter("request_id is not null")
    scored = R.evaluate(rows, keep=KEEP)
    sink = J.audit_sink(str(tmp_path / "a"))
    sink(scored, 4)
    sink(scored, 4)
    assert J.read_audit(spark, str(tmp_path / "a"), "events").count() == 3


def test_scratch_folder_follows_the_setting(spark, monkeypatch):
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: "/shared/dir/")
    assert session.scratch_path(spark, "x").startswith("/shared/dir/x-")
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: None)
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
