"""Posted records into published tables: validation, references, new ids, an outcome for each post.

Every job publishes the new rows together with a row in `posts` for each post, keyed by (kind, post_id).
Posts that are known already get the outcome they had and add nothing, so a batch may be sent again. Of
posts with one id in a batch the smallest row counts. Ids go up without gaps in the order of post_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.operators import quality as Q
from tidegate.operators import rulestore as K
from tidegate.operators import sessions as S
from tidegate.session import checkpoint
from tidegate.sources.publish import SCHEMAS, Change, TableSet, Version

POSTS = "kind string, post_id long, status int, id long, error string"
SCHEMAS.setdefault("posts", POSTS)

#: Answers by error text; everything else that is refused is a bad request.
STATUS = {
    "Session not found": 404, "Referenced event does not exist": 404, "Referenced rule does not exist": 404,
    "rule_code already exists": 409,
}


def with_ids(rows: DataFrame, order: list[str], first: int, name: str) -> tuple[DataFrame, int]:
    """(`rows` with consecutive numbers from `first` in column `name`, the first number that is left).

    Rows are range-partitioned and sorted, written once, counted by partition; each partition starts behind
    the sum of those before it. Only the counts, one for each partition, reach the driver.
    """
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(rows.repartitionByRange(count, *order).sortWithinPartitions(*order))
    place = F.monotonically_increasing_id()
    sizes = dict(dealt.groupBy(F.spark_partition_id().alias("p")).count().collect())
    starts, at = [], first
    for part in sorted(sizes):
        starts.append((part, at))
        at += sizes[part]
    offsets = rows.sparkSession.createDataFrame(starts, "_p int, _start long")
    numbered = dealt.withColumns({"_p": F.spark_partition_id(), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))})
    made = numbered.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_start") + F.col("_at"))
    return made.drop("_p", "_start", "_at"), at


def _status(error: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.when(error.isNull(), 201).otherwise(F.coalesce(known[error], F.lit(400)))


def _post(tables: TableSet, kind: str, posts: DataFrame, target: str, judge: Callable[[DataFrame, Version], DataFrame],
          rows_of: Callable[[DataFrame], DataFrame], writer: str | None = None, batch: int | None = None) -> DataFrame:
    """Publishes the accepted posts and returns (post_id, status, id, error) of all of `posts`.

    `judge` adds `error` and `_row`; `rows_of` makes rows of the target from accepted ones with their `id`.
    """
    rest = F.struct(*[F.col(c) for c in posts.columns if c != "post_id"])
    once = posts.groupBy("post_id").agg(F.min(rest).alias("_first")).select("post_id", "_first.*")

    def job(now: Version) -> Change:
        known = tables.table("posts", now).where(F.col("kind") == kind).select("post_id")
        judged = checkpoint(judge(once.join(known, "post_id", "left_anti"), now))
        good, left = with_ids(judged.where("error is null"), ["post_id"], now.counters.get(target, 0) + 1, "id")
        good = checkpoint(good)
        told = good.select("post_id", "id", F.lit(None).cast("string").alias("error")).unionByName(
            judged.where("error is not null").select("post_id", F.lit(None).cast("long").alias("id"), "error")
        )
        log = told.select(F.lit(kind).alias("kind"), "post_id", _status(F.col("error")).alias("status"), "id", "error")
        return Change(added={target: rows_of(good), "posts": log}, counters={target: left - 1})

    tables.change(job, writer, batch)
    every = tables.table("posts").where(F.col("kind") == kind)
    return every.join(posts.select("post_id").distinct(), "post_id", "left_semi").select("post_id", "status", "id", "error")


def post_events(tables: TableSet, posts: DataFrame, **batch) -> DataFrame:
    """Events of sessions. Input: post_id, session_id, payload. A missing session is told before a bad payload."""

    def judge(fresh: DataFrame, now: Version) -> DataFrame:
        there = tables.table("sessions", now).select("session_id", F.lit(True).alias("_there"))
        checked = Q.checked(fresh, Q.EVENTS).join(there, "session_id", "left")
        return checked.withColumn("error", F.when(F.col("_there").isNull(), F.lit("Session not found")).otherwise(F.col("error")))

    def rows(good: DataFrame) -> DataFrame:
        return good.select(
            F.col("id").alias("event_id"), F.col("session_id").cast("long").alias("session_id"), "_row.timestamp", "_row.url", "_row.guard_action",
            "_row.risk_score", "_row.http_method", "_row.headers",
        )

    return _post(tables, "event", posts, "events", judge, rows, **batch)


def post_analyses(tables: TableSet, posts: DataFrame, **batch) -> DataFrame:
    """Rule analyses of events. Input: post_id, payload. Payload, event and rule are looked at in this order."""

    def judge(fresh: DataFrame, now: Version) -> DataFrame:
        checked = checkpoint(Q.checked(fresh, Q.ANALYSES))
        asked = checked.where("error is null").select(F.col("post_id").alias("analysis_id"), "_row.event_id", "_row.rule_code")
        orphans = K.orphan_analyses(asked, tables.table("events", now), tables.table("rules", now))
        found = orphans.select(F.col("analysis_id").alias("post_id"), F.col("error").alias("_orphan"))
        return checked.join(found, "post_id", "left").withColumn("error", F.coalesce("error", "_orphan")).drop("_orphan")

    def rows(good: DataFrame) -> DataFrame:
        return good.select(F.col("id").alias("analysis_id"), "_row.event_id", "_row.rule_code", "_row.rule_score", "_row.details")

    return _post(tables, "analysis", posts, "rules_analysis", judge, rows, **batch)


def post_rules(tables: TableSet, posts: DataFrame, **batch) -> DataFrame:
    """New rules. Input: post_id, payload. A code that exists, or that an earlier valid post has taken, is refused."""

    def judge(fresh: DataFrame, now: Version) -> DataFrame:
        checked = Q.checked(fresh, Q.RULES)
        first = checked.where("error is null").groupBy("_row.rule_code").agg(F.min("post_id").alias("_first"))
        known = tables.table("rules", now).select("rule_code", F.lit(True).alias("_known"))
        state = checked.withColumn("rule_code", F.col("_row.rule_code")).join(first, "rule_code", "left").join(known, "rule_code", "left")
        taken = F.col("_row").isNotNull() & (F.col("_known").isNotNull() | (F.col("post_id") != F.col("_first")))
        return state.withColumn("error", F.coalesce("error", F.when(taken, F.lit("rule_code already exists")))).drop("_first", "_known", "rule_code")

    return _post(tables, "rule", posts, "rules", judge, lambda good: good.select("_row.*"), **batch)


def post_sessions(tables: TableSet, posts: DataFrame, **batch) -> DataFrame:
    """New sessions. Input: post_id, payload and, where a user is known, user_id."""

    def rows(good: DataFrame) -> DataFrame:
        user = F.col("user_id").cast("long") if "user_id" in good.columns else F.lit(None).cast("long")
        return good.select(
            F.col("id").alias("session_id"), user.alias("user_id"), "_row.start_time", F.lit(None).cast("timestamp").alias("end_time"),
            "_row.environment", "_row.agent_name",
        )

    return _post(tables, "session", posts, "sessions", lambda fresh, now: Q.checked(fresh, Q.SESSIONS), rows, **batch)


# ------------------------------------------------------------------ the mutations, published
def register_rules(tables: TableSet, candidates: DataFrame) -> None:
    """U1, published: rules that are not there yet."""
    tables.change(lambda now: Change(replaced={"rules": K.register_missing_rules(tables.table("rules", now), candidates)}))


def enable_rules(tables: TableSet, changes: DataFrame) -> DataFrame:
    """U2, published; returns the unknown codes."""

    def job(now: Version) -> Change:
        snapshot, unknown = K.set_rules_enabled(tables.table("rules", now), changes)
        return Change(replaced={"rules": snapshot}, result=unknown)

    return tables.change(job)


def close_sessions(tables: TableSet, requests: DataFrame) -> DataFrame:
    """U3, published; returns the outcome of each request."""

    def job(now: Version) -> Change:
        snapshot, outcomes = S.close_sessions(tables.table("sessions", now), requests)
        return Change(replaced={"sessions": snapshot}, result=outcomes)

    return tables.change(job)


def end_sessions(tables: TableSet, changes: DataFrame) -> None:
    """U4, published: ends set without a condition."""
    tables.change(lambda now: Change(replaced={"sessions": S.overwrite_session_end(tables.table("sessions", now), changes)}))


def delete_sessions(tables: TableSet, doomed: DataFrame) -> None:
    """U5, published: sessions, their events and the analyses of those go in one version."""

    def job(now: Version) -> Change:
        names = ("sessions", "events", "rules_analysis")
        return Change(replaced=dict(zip(names, S.delete_sessions(*[tables.table(n, now) for n in names], doomed))))

    tables.change(job)


def delete_users(tables: TableSet, doomed: DataFrame) -> None:
    """U5, published: users go, their sessions stay without a user."""

    def job(now: Version) -> Change:
        users, sessions = S.delete_users(tables.table("users", now), tables.table("sessions", now), doomed)
        return Change(replaced={"users": users, "sessions": sessions})

    tables.change(job)
