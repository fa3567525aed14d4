"""Streams over published tables: lateness, order of batches, replays, statistics."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegate.operators import sessions as S
from tidegate.plans import queries
from tidegate.sources import readers
from tidegate.sources.publish import TableSet
from tidegate.streaming import jobs as J

START = datetime(2024, 1, 1)
MOVES = "event_id long, ts timestamp, action string, environment string, agent_name string"


def moves_in_batches(delay_s, batches=6, n=240):
    """Moves of a few minutes each, shuffled over neighbouring batches within half the delay."""
    rng = random.Random(3)
    rows = [(i, START + timedelta(seconds=rng.randint(0, 20_000)), rng.choice(["start", "stop", "request"]), rng.choice(["prod", None]), rng.choice(["hot", "hot", "a", None])) for i in range(n)]
    rows.sort(key=lambda r: r[1] + timedelta(seconds=rng.uniform(0, delay_s / 2)))
    size = n // batches
    return rows, [rows[i : i + size] for i in range(0, n, size)]


def write_batches(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, MOVES).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return readers.stream_table(spark, f"{path}/in", 1)


def shown(df):
    return sorted((r["session_id"], r["start_time"], r["end_time"], r["agent_name"], r["environment"], r["replaced_session_id"], r["end_reason"]) for r in df.collect())


def test_rotation_of_shuffled_batches(spark, tmp_path):
    rows, batches = moves_in_batches(6000)
    out = str(tmp_path / "out")
    stream = write_batches(spark, tmp_path, [*batches, [(900, None, "start", "prod", "a"), (901, START - timedelta(days=9), "start", "prod", "a")]])
    J.rotate_stream(stream, out, str(tmp_path / "check"), 6000).awaitTermination()
    tables = J.settle_rotation(spark, out)
    whole = S.rotate_sessions(spark.createDataFrame(rows, MOVES))
    assert shown(tables.table("closed")) == shown(whole.filter("end_time is not null")) and tables.table("closed").count() > 50
    assert shown(tables.table("open")) == shown(whole.filter("end_time is null")) and tables.table("pending").count() == 0
    assert {r["event_id"]: r["reason"] for r in tables.table("rejected").collect()} == {900: "no time", 901: "late"}
    assert tables.current().batches["rotation"] == 6


def test_stateful_rotation_waits_for_the_watermark(spark, tmp_path):
    rows, batches = moves_in_batches(6000)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, J.ROCKSDB)
    try:
        last = max(r[1] for r in rows) + timedelta(days=1)
        stream = write_batches(spark, tmp_path, [*batches, [(999, last, "start", "prod", "clock")]])
        closed = J.session_stream(stream, "6000 seconds")
        query = closed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        query.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    whole = S.rotate_sessions(spark.createDataFrame(rows, MOVES)).filter("end_time is not null")
    assert shown(spark.read.parquet(str(tmp_path / "out"))) == shown(whole)
    odd = spark.createDataFrame([(1, None, "start", "prod", "a"), (2, START, "stop", "prod", "a")], MOVES)
    assert [r["event_id"] for r in J.timeless_moves(odd).collect()] == [1]


@pytest.mark.parametrize("compact_after", [2, 50])
def test_stats_batch_by_batch(spark, tmp_path, compact_after):
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 5), rng.choice(["Allow", "Warn", "Block"]), rng.random()) for i in range(90)]
    schema = "event_id long, session_id long, guard_action string, risk_score double"
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = str(tmp_path / "out")
    stream = readers.stream_table(spark, f"{tmp_path}/in", 1)
    J.publish_stats(stream, out, str(tmp_path / "check"), compact_after=compact_after).awaitTermination()
    got = {r["session_id"]: (r["total_events"], r["block"], round(r["average_risk_score"], 9)) for r in J.read_stats(spark, out).collect()}
    of = {s: [r for r in rows if r[1] == s] for s in range(1, 6)}
    assert got == {s: (len(r), sum(x[2] == "Block" for x in r), round(sum(x[3] for x in r) / len(r), 9)) for s, r in of.items()}
    assert TableSet(spark, out).current().number == 3


def test_a_failing_batch_is_not_seen(spark, tmp_path):
    """A batch whose last table cannot be written leaves none of its tables visible."""
    out = TableSet(spark, str(tmp_path / "set"))
    from tidegate.sources.publish import Change

    good, bad = spark.range(3), spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        out.change(lambda now: Change(added={"events": good, "log": bad}), "audit", 0)
    assert out.current().number == 0
    out.change(lambda now: Change(added={"events": good, "log": good}), "audit", 0)
    assert out.table("events").count() == out.table("log").count() == 3


def test_streams_of_one_file(spark):
    assert queries.V.load(spark, "/root/testdata/sf0.001", "lifecycle", stream=True).isStreaming
