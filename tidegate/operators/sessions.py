"""Session life cycle, attribution of requests and running session context.

Agents and sessions can be very uneven: one (agent, environment) or one session may hold a third of
all rows, in a day or in a microsecond. No window here runs over such a key as a whole: `scan` cuts it
into parts of equal size and carries what crosses their borders.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import text as X
from tidegate.functions import urls as U
from tidegate.operators import scan
from tidegate.session import checkpoint
from tidegate.sources import dims

SUPERSEDED = "superseded_by_new_proxy_session"
STOPPED = "proxy_stopped"
NO_SESSION = "No active proxy session is available"


def _agent_key(agent: str = "agent_name", env: str = "environment") -> dict[str, Column]:
    return {
        "agent_name": X.clean_agent(F.col(agent)),
        "environment": F.coalesce(F.col(env), F.lit(dims.DEFAULT_ENVIRONMENT)),
    }


# ------------------------------------------------------------------ W4, W5
def rotate_sessions(lifecycle: DataFrame, parts: int | None = None) -> DataFrame:
    """Sessions from start and stop events; the session id is the id of the start event.

    A start closes the open session of its (agent, environment); a stop closes it too and is a no-op
    where none is open. So a session ends at the next event of its key, wherever that lies.
    """
    key = ["agent_name", "environment"]
    moves = (
        lifecycle.filter(F.col("action").isin("start", "stop"))
        .withColumns(_agent_key())
        .select(*key, "ts", "event_id", F.struct("ts", "event_id", "action").alias("move"))
    )
    return (
        scan.beside(moves, key, ["ts", "event_id"], "move", parts)
        .filter("move.action = 'start'")
        .select(
            F.col("move.event_id").alias("session_id"),
            F.lit(None).cast("long").alias("user_id"),
            F.col("move.ts").alias("start_time"),
            F.col("following.ts").alias("end_time"),
            "environment",
            "agent_name",
            F.when(F.col("previous.action") == "start", F.col("previous.event_id")).alias("replaced_session_id"),
            F.when(F.col("following.action") == "start", F.lit(SUPERSEDED))
            .when(F.col("following.action") == "stop", F.lit(STOPPED))
            .alias("end_reason"),
        )
    )


def session_records(rotated: DataFrame) -> DataFrame:
    """Audit records of session starts and ends (sink schema B)."""
    common = [F.col("agent_name").alias("agent"), "environment", "session_id"]
    started = rotated.select(
        X.iso_z(F.col("start_time")).alias("timestamp"),
        *common,
        F.lit("proxy_session_started").alias("event"),
        "replaced_session_id",
    )
    closed = rotated.filter("end_time is not null").select(
        X.iso_z(F.col("end_time")).alias("timestamp"),
        *common,
        F.lit("proxy_session_closed").alias("event"),
        F.col("end_reason").alias("reason"),
    )
    return started.unionByName(closed, allowMissingColumns=True)


def latest_open_sessions(sessions: DataFrame) -> DataFrame:
    """The newest open session per (agent, environment)."""
    return (
        sessions.filter("end_time is null")
        .groupBy("agent_name", "environment")
        .agg(F.max("session_id").alias("session_id"))
    )


# ------------------------------------------------------------------ J9
#: Parts are numbered below 2^20.
_LEVELS = 20


def _cover(first: Column, end: Column, levels: int) -> Column:
    """The fewest power-of-two blocks that make up [first, end): at most two per level."""

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low, high = F.ceil(first / size), F.floor(end / size)
        left = F.when((low < high) & (low % 2 == 1), low)
        right = F.when((low < high) & (high % 2 == 1), high - 1)
        return F.transform(
            F.array_compact(F.array(left, right)),
            lambda n: F.struct(level.alias("level"), n.cast("long").alias("block")),
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), at))


def _newest_over(points: DataFrame, spans: DataFrame, key: list[str], levels: int, name: str) -> DataFrame:
    """For each distinct (key, `at`) of `points` under a span: the largest `session_id` of the spans
    [first, end) over it, as `name`.

    Points never meet spans: both meet power-of-two blocks, where spans are reduced to a maximum. Points may repeat; give them distinct where many do.
    """
    blocks = (
        spans.select(*key, "session_id", F.explode(_cover(F.col("first"), F.col("end"), levels)).alias("b"))
        .groupBy(*key, "b.level", "b.block")
        .agg(F.max("session_id").alias("session_id"))
    )
    # Per key, a bit mask of the block sizes that occur: points look up no others.
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    used = blocks.groupBy(*key).agg(F.bit_or(bit).alias("used"))
    occurring = F.filter(
        F.sequence(F.lit(0), F.lit(levels - 1)),
        lambda level: F.col("used").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), level)) != 0,
    )
    looked_up = F.transform(
        occurring,
        lambda level: F.struct(level.alias("level"), F.call_function("shiftright", F.col("at"), level).alias("block")),
    )
    return (
        points.select(*key, "at")
        .join(used, key)
        .select(*key, "at", F.inline(looked_up))
        .join(blocks, [*key, "level", "block"])
        .groupBy(*key, "at")
        .agg(F.max("session_id").alias(name))
    )


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (agent, environment, part, at, kind, id, end) in that order -> the answers of the points (kind 2).

    Sessions lie in a heap by id; one that has ended is thrown away when it comes up. The heap is emptied
    at the end of a part.
    """
    now, open_ = None, []
    for batch in batches:
        rows, answers = [], []
        columns = [c.to_pylist() for c in batch.columns]
        for i, (agent, env, part, at, kind, session, end) in enumerate(zip(*columns)):
            if (agent, env, part) != now:
                now, open_ = (agent, env, part), []
            if kind < 2:
                heappush(open_, (-session, end))
                continue
            while open_ and open_[0][1] is not None and open_[0][1] <= at:
                heappop(open_)
            if open_:
                rows.append(i)
                answers.append(-open_[0][0])
        chosen = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [chosen.column(0), chosen.column(1), chosen.column(3), pa.array(answers, pa.int64())], names=["agent_name", "environment", "at", "open_session_id"]
        )


def open_session_at(requests: DataFrame, sessions: DataFrame, parts: int | None = None) -> DataFrame:
    """J9 without explicit ids: adds `open_session_id`, the newest session open at `ts`, or null.

    A sweep over the starts and the times asked for, in parts of equal size. Each session goes to the part
    of its start and, if it goes on, to the part of its end; in the parts between it is open all the time,
    so of those sessions only the newest one counts there.
    """
    key = ["agent_name", "environment"]
    asked = requests.withColumns(_agent_key())
    points = asked.select(*key, F.unix_micros("ts").alias("at")).distinct()
    none = F.lit(None).cast("long")
    micros = {"at": F.unix_micros("start_time"), "end": F.unix_micros("end_time")}
    started = sessions.withColumns(micros).filter("`at` is not null and session_id is not null and (`end` is null or `end` > `at`)")
    rows = started.select(*key, "at", F.lit(1).alias("kind"), F.col("session_id").cast("long").alias("id"), "end")
    rows = rows.unionByName(points.select(*key, "at", F.lit(2).alias("kind"), none.alias("id"), none.alias("end")))
    parted = scan.in_parts(rows, key, ["at", "kind", "id"], parts)

    borders = checkpoint(scan.summaries(parted, key, {"begin": F.min("at")}))
    of_key = borders.groupBy(*key).agg(F.collect_list(F.struct("begin", scan.PART)).alias("parts"), (F.max(scan.PART) + 1).alias("beyond"))
    last = F.array_max(F.transform(F.filter("parts", lambda p: p["begin"] < F.col("end")), lambda p: p[scan.PART]))
    carried = parted.filter("kind = 1").join(F.broadcast(of_key), key).withColumn("last", F.when(F.col("end").isNotNull(), last))
    whole = carried.select(*key, F.col("id").alias("session_id"), (F.col(scan.PART) + 1).cast("long").alias("first"),
                           F.coalesce("last", "beyond").cast("long").alias("end"))
    between = _newest_over(borders.select(*key, F.col(scan.PART).cast("long").alias("at")), whole, key, _LEVELS, "id")
    at_start = [F.lit(None).cast("long").alias("at"), F.lit(0).alias("kind")]
    swept = (
        parted.select(*key, scan.PART, "at", "kind", "id", "end")
        .unionByName(between.select(*key, F.col("at").cast("int").alias(scan.PART), *at_start, "id", none.alias("end")))
        .unionByName(carried.filter(F.col("last") > F.col(scan.PART)).select(*key, F.col("last").alias(scan.PART), *at_start, "id", "end"))
        .repartition(*key, scan.PART)
        .sortWithinPartitions(*key, scan.PART, "at", "kind")
    )
    found = swept.mapInArrow(_sweep, "agent_name string, environment string, at bigint, open_session_id bigint")
    return asked.withColumn("at", F.unix_micros("ts")).join(found, [*key, "at"], "left").drop("at").select(*asked.columns, "open_session_id")


def attribute_sessions(requests: DataFrame, sessions: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds the resolved `session_id`, `environment` and `agent_name`, and `error`.

    An explicit session must exist, be open at the time of the request and agree with the
    environment and agent where the request names them; otherwise the newest open session of the
    agent is taken. `ts` is event time: a session is open while start <= ts < end.
    """
    explicit = requests.filter("session_id is not null")
    implicit = requests.filter("session_id is null").drop("session_id")
    known = sessions.select(
        "session_id",
        F.col("environment").alias("s_env"),
        F.col("agent_name").alias("s_agent"),
        "start_time",
        "end_time",
    )
    open_then = F.col("end_time").isNull() | (F.col("ts") < F.col("end_time"))
    named_agent = F.when(X.strip(F.col("agent_name")) != "", X.clean_agent(F.col("agent_name")))
    error = (
        F.when(F.col("s_env").isNull(), F.lit("Provided session_id does not reference an existing session"))
        .when(~open_then, F.lit("Provided session_id is already closed"))
        .when(
            F.col("environment") != F.col("s_env"),
            F.lit("Provided environment does not match the referenced session"),
        )
        .when(
            named_agent != F.col("s_agent"),
            F.lit("Provided agent_name does not match the referenced session"),
        )
    )
    checked = (
        explicit.join(known, "session_id", "left")
        .withColumn("error", error)
        .withColumns(
            {"environment": F.coalesce("s_env", "environment"), "agent_name": F.coalesce("s_agent", "agent_name")}
        )
        .drop("s_env", "s_agent", "start_time", "end_time")
    )
    found = (
        open_session_at(implicit, sessions, parts)
        .withColumnRenamed("open_session_id", "session_id")
        .withColumn("error", F.when(F.col("session_id").isNull(), F.lit(NO_SESSION)))
    )
    return checked.unionByName(found)


# ------------------------------------------------------------------ W1–W3
def session_context(events: DataFrame, parts: int | None = None) -> DataFrame:
    """What happened in the session before each event.

    Adds `position`, the number of earlier events: the previous URLs of an event are those at smaller
    positions of its session (`previous_urls`, `latest_urls`). Adds `sensitive_interaction_count` and
    `unique_domains_visited`. Input: session_id, event_id, timestamp, url, sensitive. Order: timestamp, event_id.
    """
    moment = F.struct("timestamp", "event_id")
    visits = (
        events.select("session_id", "event_id", "timestamp", U.host(F.col("url")).alias("host"))
        .groupBy("session_id", "host")
        .agg(F.min(moment).alias("m"))
        .select(F.col("m.event_id").alias("event_id"), F.lit(1).cast("long").alias("_fresh"))
    )
    sums = {
        "position": F.lit(1).cast("long"),
        "sensitive_interaction_count": F.coalesce(F.col("sensitive").cast("long"), F.lit(0).cast("long")),
        "unique_domains_visited": F.coalesce(F.col("_fresh"), F.lit(0).cast("long")),
    }
    rows = events.join(visits, "event_id", "left")
    return scan.running(rows, ["session_id"], ["timestamp", "event_id"], sums, parts).select(*events.columns, *sums)


def previous_urls(context: DataFrame, asked: DataFrame) -> DataFrame:
    """W1 for the events in `asked` (event_id): (event_id, session_id, position, url), a row for each earlier event.

    `context` is the result of `session_context`. A whole history is as long as its session, so it comes as
    rows, and only for what is asked for.
    """
    wanted = context.join(asked.select("event_id").distinct(), "event_id", "left_semi").select(
        "event_id", F.col("session_id").alias("_session"), F.col("position").alias("_until")
    )
    same = (F.col("session_id") == F.col("_session")) & (F.col("position") < F.col("_until"))
    return context.drop("event_id").join(wanted, same).select("event_id", "session_id", "position", "url")


def whole_histories(events: DataFrame, parts: int | None = None) -> DataFrame:
    """W1 for every event: `previous_urls`, all earlier URLs of its session, oldest first."""
    return scan.gathered(events, ["session_id"], ["timestamp", "event_id"], "url", "previous_urls", parts)


def latest_urls(context: DataFrame, depth: int) -> DataFrame:
    """W1 with a bound: event_id and `previous_urls`, its latest `depth` earlier URLs, oldest first."""
    later = F.explode(F.sequence(F.col("position") + 1, F.col("position") + depth))
    told = context.select("session_id", later.alias("position"), F.struct("position", "url").alias("past"))
    lists = told.groupBy("session_id", "position").agg(F.sort_array(F.collect_list("past")).alias("past"))
    return context.join(lists, ["session_id", "position"], "left").select(
        "event_id", F.coalesce(F.transform("past", lambda p: p["url"]), F.array().cast("array<string>")).alias("previous_urls")
    )


# ------------------------------------------------------------------ U3–U5
def close_sessions(sessions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, outcomes). Requests carry request_id, session_id, end_time.

    An end is set only where none is set; of several requests for one session the earliest wins.
    Outcomes are closed, already_closed and not_found.
    """
    winners = requests.groupBy("session_id").agg(F.min(F.struct("end_time", "request_id")).alias("win"))
    joined = sessions.join(winners, "session_id", "left")
    snapshot = joined.withColumn("end_time", F.coalesce("end_time", "win.end_time")).select(*sessions.columns)
    state = sessions.select("session_id", F.col("end_time").isNull().alias("was_open")).join(
        winners.select("session_id", F.col("win.request_id").alias("winner")), "session_id"
    )
    outcomes = requests.join(state, "session_id", "left").select(
        "request_id",
        "session_id",
        F.when(F.col("was_open").isNull(), F.lit("not_found"))
        .when(F.col("was_open") & (F.col("winner") == F.col("request_id")), F.lit("closed"))
        .otherwise(F.lit("already_closed"))
        .alias("outcome"),
    )
    return snapshot, outcomes


def overwrite_session_end(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """U4: sets the end without a condition; the last change (by request_id) of a session counts."""
    last = changes.groupBy("session_id").agg(F.max_by("end_time", "request_id").alias("new_end"))
    return (
        sessions.join(last, "session_id", "left")
        .withColumn("end_time", F.coalesce("new_end", "end_time"))
        .select(*sessions.columns)
    )


def delete_sessions(
    sessions: DataFrame, events: DataFrame, analyses: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New snapshots without the doomed sessions, their events and the analyses of those."""
    ids = doomed.select("session_id").distinct()
    gone = events.join(ids, "session_id", "left_semi").select("event_id")
    return (
        sessions.join(ids, "session_id", "left_anti"),
        events.join(ids, "session_id", "left_anti"),
        analyses.join(gone, "event_id", "left_anti"),
    )


def delete_users(users: DataFrame, sessions: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions of a deleted user stay, without their user."""
    ids = doomed.select("user_id").distinct().withColumn("gone", F.lit(True))
    kept = (
        sessions.join(ids, "user_id", "left")
        .withColumn("user_id", F.when(F.col("gone").isNull(), F.col("user_id")))
        .select(*sessions.columns)
    )
    return users.join(ids, "user_id", "left_anti"), kept
