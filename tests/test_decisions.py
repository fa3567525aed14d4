"""The decision job: batch and stream, from payloads to enforcement."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidegate import schemas
from tidegate.operators import decisions as D
from tidegate.operators import sessions as S
from tidegate.sources import writers
from tidegate.streaming import jobs as J

AGENT = {"User-Agent": "Mozilla/5.0 Chrome/120.0", "Content-Type": "text/html"}
SESSIONS = [
    (1, None, "2024-01-01 00:00:00", None, "prod", "amber"),
    (2, None, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "test", "amber"),
]


def post(url="https://quiet-meadow.example/a", at="2024-01-03T00:00:00Z", **more):
    return json.dumps({"url": url, "method": "GET", "headers": AGENT, "body": "<p>x</p>", "timestamp": at} | more)


POSTS = {
    1: post(agent_name="amber"),  # no environment named: the default one
    2: post("http://quiet-meadow.example/a", agent_name="amber", session_id=1, environment="prod"),
    3: post(session_id=2),
    4: post(session_id=9),
    5: post(session_id=1, environment="test"),
    6: post(agent_name="nobody"),
    7: post("https://metrics.quiet-meadow.example/a", agent_name="amber"),
    8: post(agent_name="amber", headers={"User-Agent": "curl/8"}),
    9: "[]",
    10: post(session_id=2, at="2024-01-01T12:00:00Z"),  # the environment of the session, not the default
    11: post("https://metrics.listed.example/a", agent_name="amber"),  # a blocklist match wins over noise
    12: None,
}
WANT = {
    1: (1, "allow", "backend", None, None),
    2: (1, "block", "backend", 403, None),
    3: (None, "block", "backend_error", 503, "Provided session_id is already closed"),
    4: (None, "block", "backend_error", 503, "Provided session_id does not reference an existing session"),
    5: (None, "block", "backend_error", 503, "Provided environment does not match the referenced session"),
    6: (None, "block", "backend_error", 503, S.NO_SESSION),
    9: (None, "block", "backend_error", 503, "JSON request body is required"),
    10: (2, "allow", "backend", None, None),
    11: (1, "block", "backend", 403, None),
    12: (None, "block", "backend_error", 503, "JSON request body is required"),
}


def inputs(spark):
    sessions = spark.createDataFrame(SESSIONS, "session_id long, user_id long, s string, e string, environment string, agent_name string")
    sessions = sessions.withColumns({"start_time": F.to_timestamp("s"), "end_time": F.to_timestamp("e")}).drop("s", "e")
    blocks = spark.createDataFrame([("listed.example",)], "entry string")
    return sessions, spark.createDataFrame([], "domain string"), blocks


def shown(df):
    return {r.request_id: (r.session_id, r.decision, r.source, r.status_code, r.error) for r in df.collect()}


def test_batch(spark, tmp_path):
    sessions, filters, blocks = inputs(spark)
    rows = spark.createDataFrame(list(POSTS.items()), "request_id long, payload string")
    out = str(tmp_path)
    got = D.decide_traffic(rows, sessions, filters, None, blocks, sink=lambda r: writers.write_audit_tables(r, out))
    assert shown(got) == WANT
    events = {r.event_id: r.session_id for r in spark.read.parquet(f"{out}/events").collect()}
    assert events == {1: 1, 2: 1, 10: 2, 11: 1}
    assert spark.read.parquet(f"{out}/rules_analysis").select("event_id").distinct().count() == 4


def test_open_and_passive(spark):
    sessions, filters, blocks = inputs(spark)
    rows = spark.createDataFrame(list(POSTS.items()), "request_id long, payload string")
    got = shown(D.decide_traffic(rows, sessions, filters, None, blocks, failure_mode="fail_open", passive=True))
    assert got[2][1:4] == ("block", "backend", None)
    assert got[3][1:4] == ("allow", "backend_error", None)


def test_no_payloads(spark):
    sessions, filters, blocks = inputs(spark)
    rows = spark.createDataFrame([], "request_id long, payload string")
    assert D.decide_traffic(rows, sessions, filters, None, blocks).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    sessions, filters, blocks = inputs(spark)
    rows = spark.createDataFrame(list(POSTS.items()), "request_id long, payload string")
    rows.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    J.decide_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check", lambda: sessions, filters, blocklist=blocks).awaitTermination()
    assert shown(J.read_audit(spark, f"{tmp_path}/out", "outcomes")) == WANT
    assert J.read_audit(spark, f"{tmp_path}/out", "events").filter("session_id is null").count() == 0
    lines = [json.loads(r.value) for r in J.read_audit(spark, f"{tmp_path}/out", "log").collect()]
    assert {x["event_id"]: x["session_id"] for x in lines} == {1: 1, 2: 1, 10: 2, 11: 1}


def test_hot_slot_of_sessions(spark):
    """One agent and five minutes hold a third of the rows, beside sessions of every kind."""
    import random

    rng = random.Random(5)
    spans = [(i, rng.randrange(0, 900), rng.choice([None, rng.randrange(0, 900)])) for i in range(120)]
    asks = [(i, rng.randrange(300, 600) if i % 3 == 0 else rng.randrange(0, 1200)) for i in range(600)]
    moment = lambda c: F.timestamp_seconds(F.col(c) + 1_700_000_000)
    sessions = spark.createDataFrame(spans, "session_id long, a long, b long").select(
        "session_id", moment("a").alias("start_time"), moment("b").alias("end_time"), F.lit("prod").alias("environment"),
        F.lit("amber").alias("agent_name"),
    )
    rows = spark.createDataFrame(asks, "event_id long, t long").select(
        "event_id", moment("t").alias("ts"), F.lit("prod").alias("environment"), F.lit("amber").alias("agent_name")
    )
    got = {r.event_id: r.open_session_id for r in S.open_session_at(rows, sessions).collect()}
    want = {i: max((s for s, a, b in spans if a <= t and (b is None or t < b)), default=None) for i, t in asks}
    assert got == want


def test_sessions_schema_is_what_the_job_takes(spark):
    sessions, _, _ = inputs(spark)
    assert set(sessions.columns) == {c.split()[0] for c in schemas.SESSIONS.split(", ")}
