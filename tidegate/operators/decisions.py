"""The whole job from request payloads to enforced decisions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import text as X
from tidegate.operators import enforcement as E
from tidegate.operators import filters as T
from tidegate.operators import matching as M
from tidegate.operators import quality as Q
from tidegate.operators import rules as R
from tidegate.operators import sessions as S
from tidegate.session import scratch_path

_KEPT = (
    "request_id", "url", "method", "timestamp", "environment", "environment_given", "agent_name", "session_id",
    "req_headers", "error",
)


def _written(df: DataFrame, name: str) -> DataFrame:
    """Thin rows that several steps read again: a table in the shared folder, so lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _forwarded(rows: DataFrame, filter_list: DataFrame, blocklist: DataFrame | None) -> DataFrame:
    """F10 over thin rows. The list counts here even where its rule is disabled."""
    rows = M.with_filter_list(rows, filter_list)
    if blocklist is None:
        rows = rows.withColumn("listed_here", F.lit(False))
    else:
        rows = M.with_blocklist(rows, blocklist).withColumnRenamed("blocklisted", "listed_here")
    forward = T.should_forward(
        F.col("url"), F.col("method"), F.col("req_headers"), F.col("host_listed"), F.col("listed_here")
    )
    return rows.filter(forward).drop("host_listed", "listed_here")


def decide_traffic(
    payloads: DataFrame,
    sessions: DataFrame,
    filter_list: DataFrame,
    feed: DataFrame | None = None,
    blocklist: DataFrame | None = None,
    enabled: Mapping[str, bool] | None = None,
    book: R.RuleBook | None = None,
    sink: Callable[[DataFrame], None] | None = None,
    failure_mode: str = "fail_closed",
    passive: bool = False,
    key: str = "request_id",
    payload: str = "payload",
) -> DataFrame:
    """Validates (Q1), filters (F10), evaluates (R10), attributes (J9, Q2), audits and enforces.

    One row for each payload that is refused or forwarded: request_id, session_id, decision, reason,
    source, status_code and `error`. A refused payload, or one without an open session, has its `error`
    and counts as an unusable answer. What F10 does not forward is not in the result: it goes on unseen.
    `sink` gets the attributed rows that the audit writers take.

    Bodies are read once and end in the first table; all joins are over thin rows.
    """
    enabled = R.with_book(enabled, book)
    taken = Q.checked(payloads.select(F.col(key).alias("request_id"), payload), Q.TRAFFIC, payload).select(
        "request_id", "error", "_row.*"
    )
    # What needs no list filters before pages are parsed.
    agent = X.header(F.col("req_headers"), "user-agent")
    candidates = taken.filter(F.col("error").isNotNull() | (T.is_browser_ua(agent) & T.is_enforced_method(F.col("method"))))
    pages = _written(R.page_signals(candidates, enabled, keep=_KEPT), "decide-pages")
    refused = pages.filter("error is not null").select("request_id", "error")

    forwarded = _forwarded(pages.filter("error is null").drop("error"), filter_list, blocklist)
    rows = R.with_host_rules(forwarded, M.distinct_hosts(forwarded), feed, blocklist, enabled)
    scored = _written(R.score_rows(rows, enabled, book), "decide-scored")

    # An environment that was only a default need not agree with the session's.
    named = F.when(F.col("session_id").isNull() | F.col("environment_given"), F.col("environment"))
    asked = scored.withColumn("environment", named).drop("environment_given").withColumnRenamed("timestamp", "ts")
    attributed = _written(S.attribute_sessions(asked, sessions).withColumnRenamed("ts", "timestamp"), "decide-attributed")
    decided = attributed.filter("error is null").drop("error")
    if sink is not None:
        sink(decided)
    return _outcome(decided, refused.unionByName(attributed.filter("error is not null").select("request_id", "error")), failure_mode, passive)


def _outcome(decided: DataFrame, refused: DataFrame, failure_mode: str, passive: bool) -> DataFrame:
    def null(kind: str) -> Column:
        return F.lit(None).cast(kind)

    kind = decided.schema["rule_results"].dataType.simpleString()
    answers = decided.select("request_id", "session_id", "decision", "rule_results", null("string").alias("error")).unionByName(
        refused.select(
            "request_id", null("long").alias("session_id"), null("string").alias("decision"), null(kind).alias("rule_results"), "error"
        )
    )
    return E.enforced(answers.withColumns({"passive": F.lit(passive), "came_back": F.lit(True)}), failure_mode, "session_id", "error")
