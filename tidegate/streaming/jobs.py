"""Structured Streaming: the batch jobs over streams of traffic, events and session moves."""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidegate import schemas
from tidegate.functions import text as X
from tidegate.operators import decisions as D
from tidegate.operators import reports as A
from tidegate.operators import rules as R
from tidegate.operators import sessions as S
from tidegate.session import checkpoint
from tidegate.sources import dims, readers, writers
from tidegate.sources.publish import Change, ConcurrentChange, TableSet, Version

# The stateful processor travels with the query, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_traffic_stream(spark: SparkSession, in_dir: str, max_files: int | None = None, agent_headers: tuple[str, ...] = X.AGENT_HEADERS) -> DataFrame:
    """The traffic source as a stream of JSON files."""
    reader = spark.readStream.schema(schemas.TRAFFIC)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return readers.finish_traffic(reader.json(in_dir), agent_headers)


def score_stream(
    traffic: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint_dir: str,
    feed: DataFrame | None = None,
    blocklist: DataFrame | None = None,
    enabled: Mapping[str, bool] | None = None,
    sessions: DataFrame | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Scores a traffic stream with the batch evaluation, micro-batch by micro-batch.

    Scoring keeps no state between batches, so each batch runs the very plan of the batch job
    (distinct hosts, then equi joins with the dimensions) and the results are equal by construction.
    Dimensions are read again for every batch, so that a new snapshot takes effect. With `sessions`,
    requests are attributed too and unattributed ones are left out.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        keep = (
            "request_id", "url", "method", "timestamp", "environment", "agent_name", "session_id", "req_headers",
        )
        scored = R.evaluate(rows, feed, blocklist, enabled, keep=keep)
        if sessions is not None:
            found = S.attribute_sessions(scored.withColumnRenamed("timestamp", "ts"), sessions)
            scored = found.filter("error is null").drop("error").withColumnRenamed("ts", "timestamp")
        sink(scored, batch_id)

    return (
        traffic.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _audit_rows(scored: DataFrame) -> dict[str, DataFrame]:
    """The audit tables of a batch; its thin rows are written once."""
    kept = checkpoint(scored)
    return {
        "events": writers.audit_events(kept), "rules_analysis": writers.audit_analyses(kept),
        "log": writers.audit_lines(writers.decision_records(kept)),
    }


def audit_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Adds events, rules_analysis and the JSON log of a batch to the published tables at `path`.

    The three become visible together, in one version. A batch that failed before it leaves nothing to be
    seen; one that is replayed after it adds nothing. Read the tables with `read_audit`.
    """

    def write(scored: DataFrame, batch_id: int) -> None:
        TableSet(scored.sparkSession, path).change(lambda now: Change(added=_audit_rows(scored)), "audit", batch_id)

    return write


def write_stream(traffic: DataFrame, path: str, checkpoint_dir: str, **options) -> StreamingQuery:
    """A scored stream into the audit tables."""
    return score_stream(traffic, audit_sink(path), checkpoint_dir, **options)


def decide_stream(
    payloads: DataFrame, path: str, checkpoint_dir: str, sessions: Callable[[], DataFrame], filter_list: DataFrame,
    trigger: dict | None = None, **options,
) -> StreamingQuery:
    """The decision job over a stream of payloads: audit tables and, in `outcomes`, what was enforced.

    `sessions` is called for every batch, so that it sees the sessions of that time. All tables of a
    batch are published together, once. `options` are those of `decide_traffic`.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        def job(now: Version) -> Change:
            made = Change()
            outcome = D.decide_traffic(batch, sessions(), filter_list, sink=lambda rows: made.added.update(_audit_rows(rows)), **options)
            made.added["outcomes"] = outcome
            return made

        TableSet(batch.sparkSession, path).change(job, "decide", batch_id)

    return (
        payloads.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_audit(spark: SparkSession, path: str, table: str) -> DataFrame:
    return TableSet(spark, path).table(table)


SESSION_OUTPUT = (
    "session_id long, start_time timestamp, end_time timestamp, environment string, agent_name string, "
    "replaced_session_id long, end_reason string"
)


class SessionRotation(StatefulProcessor):
    """One open session per (agent, environment); a closed session leaves as a row.

    Moves wait in the state until the watermark has passed their time; a timer at the time of each batch's
    last move of a key wakes it up. Then they are taken in order of time and id, in whatever batches they
    came. One task holds what waits of a key: the moves of the allowed delay. Use `rotate_stream` where single
    agents are very busy.
    """

    def __init__(self, superseded: str, stopped: str) -> None:
        self._reasons = {"start": superseded, "stop": stopped}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", "session_id long, start_us long, replaced long")
        self._waiting = handle.getListState("waiting", "at_us long, event_id long, action string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for frame in rows:
            moves = list(frame[["at_us", "event_id", "action"]].itertuples(index=False, name=None))
            if moves:
                self._waiting.appendList([(int(a), int(i), k) for a, i, k in moves])
                self._handle.registerTimer(max(m[0] for m in moves) // 1000 + 1)
        yield self._closed(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield self._closed(key, timerValues.getCurrentWatermarkInMs())

    def _closed(self, key, watermark_ms: int) -> pd.DataFrame:
        agent, env = key
        moves = sorted(self._waiting.get()) if self._waiting.exists() else []
        ready = [m for m in moves if m[0] < watermark_ms * 1000]
        out = []
        if ready:
            current = self._open.get() if self._open.exists() else None
            for at, event_id, action in ready:
                before = current
                if current is not None:
                    out.append((*current, at, self._reasons[action]))
                    current = None
                if action == "start":
                    current = (int(event_id), int(at), None if before is None else before[0])
            if current is None:
                self._open.clear()
            else:
                self._open.update(current)
            left = moves[len(ready):]
            if left:
                self._waiting.put(left)
            else:
                self._waiting.clear()
        frame = pd.DataFrame(out, columns=["session_id", "start_us", "replaced_session_id", "end_us", "end_reason"])
        return pd.DataFrame(
            {
                "session_id": frame["session_id"].astype("int64"),
                "start_time": pd.to_datetime(frame["start_us"].astype("int64"), unit="us"),
                "end_time": pd.to_datetime(frame["end_us"].astype("int64"), unit="us"),
                "environment": env,
                "agent_name": agent,
                "replaced_session_id": frame["replaced_session_id"].astype("Int64"),
                "end_reason": frame["end_reason"].astype("object"),
            }
        )

    def close(self) -> None:
        pass


def _moves(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.filter(F.col("action").isin("start", "stop")).select("event_id", "ts", "action", "environment", "agent_name")


def session_stream(lifecycle: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Closed sessions from a stream of start and stop moves, which may come up to `delay` late.

    Needs the RocksDB state store. Later moves are dropped by the watermark, which counts them in the
    query's progress; moves without a time never get here: take them from `timeless_moves`.
    """
    moves = (
        _moves(lifecycle).filter("ts is not null and event_id is not null")
        .withWatermark("ts", delay)
        .withColumn("agent_name", X.clean_agent(F.col("agent_name")))
        .withColumn("environment", F.coalesce("environment", F.lit(dims.DEFAULT_ENVIRONMENT)))
        .select("agent_name", "environment", "ts", "event_id", F.unix_micros("ts").alias("at_us"), "action")
    )
    return moves.groupBy("agent_name", "environment").transformWithStateInPandas(
        statefulProcessor=SessionRotation(S.SUPERSEDED, S.STOPPED),
        outputStructType=SESSION_OUTPUT,
        outputMode="Append",
        timeMode="EventTime",
    )


def timeless_moves(lifecycle: DataFrame) -> DataFrame:
    """The moves that no rotation can place, for a sink of their own."""
    return _moves(lifecycle).filter("ts is null or event_id is null")


MOVES = "event_id long, ts timestamp, action string, environment string, agent_name string"
REJECTED = MOVES + ", reason string"


def _rotated(tables: TableSet, now: Version, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(closed, open) after `moves`, which are later than all that was settled in version `now`."""
    before = tables.table("open", now)
    again = before.select(
        F.col("session_id").alias("event_id"), F.col("start_time").alias("ts"), F.lit("start").alias("action"), "environment", "agent_name"
    )
    carried = before.select("session_id", F.col("replaced_session_id").alias("carried"))
    rotated = S.rotate_sessions(moves.unionByName(again)).drop("user_id").join(carried, "session_id", "left")
    rotated = checkpoint(rotated.withColumn("replaced_session_id", F.coalesce("replaced_session_id", "carried")).drop("carried"))
    return rotated.filter("end_time is not null"), rotated.filter("end_time is null")


def rotation_tables(spark: SparkSession, path: str) -> TableSet:
    """`closed` and `open` sessions, moves that wait (`pending`) and that came too late or without a time (`rejected`)."""
    tables = TableSet(spark, path)
    if not tables.current().number:
        empty = {"closed": SESSION_OUTPUT, "open": SESSION_OUTPUT, "pending": MOVES, "rejected": REJECTED}
        try:
            tables.publish(Change(replaced={name: spark.createDataFrame([], ddl) for name, ddl in empty.items()}), Version())
        except ConcurrentChange:
            pass
    return tables


def rotate_stream(
    lifecycle: DataFrame, path: str, checkpoint_dir: str, delay_seconds: int = 3600, trigger: dict | None = None
) -> StreamingQuery:
    """X3 for uneven agents: the batch rotation per micro-batch, over published tables (`rotation_tables`).

    No task holds the moves of one agent. Moves wait until the newest time seen, less the delay, has passed
    them; so batches may bring them in any order. A move older than what was settled already, or without a
    time, is kept in `rejected`. Each batch is one version: closed and open sessions always fit together.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        tables = rotation_tables(batch.sparkSession, path)
        moves = checkpoint(_moves(batch))

        def job(now: Version) -> Change:
            mark = now.counters.get("settled_us", -(1 << 62))
            newest = moves.agg(F.max(F.unix_micros("ts"))).first()[0]
            settled = mark if newest is None else max(mark, newest - delay_seconds * 1_000_000)
            at = F.unix_micros("ts")
            reason = F.when(at.isNull() | F.col("event_id").isNull(), "no time").when(at < mark, "late")
            judged = moves.withColumn("reason", reason)
            waiting = tables.table("pending", now).unionByName(judged.filter("reason is null").drop("reason"))
            closed, open_ = _rotated(tables, now, waiting.filter(at < settled))
            return Change(
                added={"closed": closed, "rejected": judged.filter("reason is not null")},
                replaced={"open": open_, "pending": waiting.filter(at >= settled)}, counters={"settled_us": settled},
            )

        tables.change(job, "rotation", batch_id)

    return (
        lifecycle.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def settle_rotation(spark: SparkSession, path: str) -> TableSet:
    """Rotates all that still waits, where no more moves will come."""
    tables = rotation_tables(spark, path)

    def job(now: Version) -> Change:
        waiting = tables.table("pending", now)
        newest = waiting.agg(F.max(F.unix_micros("ts"))).first()[0]
        if newest is None:
            return Change()
        closed, open_ = _rotated(tables, now, waiting)
        return Change(added={"closed": closed}, replaced={"open": open_, "pending": waiting.limit(0)}, counters={"settled_us": newest + 1})

    tables.change(job)
    return tables


def stats_stream(events: DataFrame) -> DataFrame:
    """Running statistics per session, for update or complete mode."""
    return A.event_stats(events)


def publish_stats(
    events: DataFrame, path: str, checkpoint_dir: str, trigger: dict | None = None, compact_after: int = 50
) -> StreamingQuery:
    """The statistics in update mode, as rows (session, batch) of the published table `stats`.

    A batch adds the sessions it changed, in a version of its own; `read_stats` takes the newest row of
    each. After `compact_after` batches the table is written anew with those rows only.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        tables = TableSet(batch.sparkSession, path)

        def job(now: Version) -> Change:
            rows = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
            if len(now.tables.get("stats", [])) < compact_after:
                return Change(added={"stats": rows})
            return Change(replaced={"stats": _newest_stats(tables.table("stats", now).unionByName(rows))})

        tables.change(job, "stats", batch_id)

    return (
        stats_stream(events).writeStream.outputMode("update").foreachBatch(run)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _newest_stats(rows: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct(*rows.columns), "batch_id").alias("_newest")
    return rows.groupBy("session_id").agg(newest).select("_newest.*")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return _newest_stats(TableSet(spark, path).table("stats")).drop("batch_id")
