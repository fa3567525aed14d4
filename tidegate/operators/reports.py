"""Dashboard queries: statistics, listings, lookups and metadata joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import text as X


def event_stats(events: DataFrame) -> DataFrame:
    """Counts and mean risk per session, combined map-side before the shuffle."""
    action = F.col("guard_action")
    return events.groupBy("session_id").agg(
        F.count("*").alias("total_events"),
        F.count_if(action == "Allow").alias("allow"),
        F.count_if(action == "Warn").alias("warn"),
        F.count_if(action == "Block").alias("block"),
        F.avg("risk_score").alias("average_risk_score"),
    )


def session_stats(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """A1: one row per session; zeros where it has no events."""
    zeros = {"total_events": 0, "allow": 0, "warn": 0, "block": 0, "average_risk_score": 0.0}
    return sessions.select("session_id").join(event_stats(events), "session_id", "left").fillna(zeros)


def sessions_with_risk(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """The session list with its mean risk, zero where there is none."""
    stats = event_stats(events).select("session_id", "average_risk_score")
    return sessions.join(stats, "session_id", "left").fillna({"average_risk_score": 0.0})


def sessions_with_user(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """J8."""
    return sessions.join(users.select("user_id", "username"), "user_id", "left")


def analyses_with_rule(analyses: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule type and weight beside each analysis, null for an unknown rule."""
    return analyses.join(rules.select("rule_code", "rule_type", "weight"), "rule_code", "left")


def risk_level(score: Column) -> Column:
    """A5: strict bounds, unlike the decision; a missing score is low."""
    return F.when(score > 0.7, F.lit("high")).when(score > 0.4, F.lit("medium")).otherwise(F.lit("low"))


def risk_levels(rows: DataFrame, score: str = "average_risk_score") -> DataFrame:
    """A5: rows per level."""
    return rows.groupBy(risk_level(F.col(score)).alias("risk_level")).agg(F.count("*").alias("n"))


def facet_values(rules: DataFrame, column: str) -> DataFrame:
    """A3: sorted distinct values without blanks."""
    return rules.filter(F.col(column) != "").select(F.col(column).alias("value")).distinct().orderBy("value")


def session_events(events: DataFrame, session_id: int) -> DataFrame:
    """T1 for one session."""
    return events.filter(F.col("session_id") == session_id).orderBy("timestamp", "event_id")


def all_events(events: DataFrame) -> DataFrame:
    """T1 for all, newest first."""
    return events.orderBy(F.desc("timestamp"), F.desc("event_id"))


def session_list(sessions: DataFrame) -> DataFrame:
    """T2."""
    return sessions.orderBy(F.desc("session_id"))


def rule_list(rules: DataFrame) -> DataFrame:
    """T3."""
    return rules.orderBy("rule_code")


def event_analyses(analyses: DataFrame, rules: DataFrame, event_id: int) -> DataFrame:
    """T4."""
    return analyses_with_rule(analyses.filter(F.col("event_id") == event_id), rules).orderBy("analysis_id")


def latest_analyses(analyses: DataFrame, rules: DataFrame, rule_code: str, limit: int = 100) -> DataFrame:
    """T5 for one rule."""
    code = rule_code.strip() if isinstance(rule_code, str) else ""
    if not code or len(code) > 30:
        raise ValueError("rule_code is required")
    if isinstance(limit, bool) or not 1 <= int(limit) <= 1000:
        raise ValueError("Invalid limit")
    newest = analyses.filter(F.col("rule_code") == code).orderBy(F.desc("analysis_id")).limit(int(limit))
    return analyses_with_rule(newest, rules).orderBy(F.desc("analysis_id"))


def latest_analyses_per_rule(analyses: DataFrame, rules: DataFrame, limit: int = 100) -> DataFrame:
    """T5 for every rule: each task keeps its own newest rows per rule before the shuffle."""
    order = Window.partitionBy("rule_code").orderBy(F.desc("analysis_id"))
    top = analyses.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return analyses_with_rule(top, rules)


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """One row by key; the predicate reaches the scan."""
    return table.filter(F.col(key) == value)


# ------------------------------------------------------------------ C16 output shapes
def session_shape(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "session_id",
        "user_id",
        X.iso_z(F.col("start_time")).alias("start_time"),
        "agent_name",
        X.iso_z(F.col("end_time")).alias("end_time"),
        "environment",
    )


def event_shape(events: DataFrame, with_session: bool = False) -> DataFrame:
    columns = [
        "event_id",
        X.iso_z(F.col("timestamp")).alias("timestamp"),
        "url",
        "guard_action",
        F.col("risk_score").cast("double").alias("risk_score"),
        "http_method",
        "headers",
    ]
    return events.select(*columns, *(["session_id"] if with_session else []))


def rule_shape(rules: DataFrame) -> DataFrame:
    return rules.select(
        "rule_code",
        F.col("weight").cast("double").alias("weight"),
        "rule_type",
        "compute_class",
        F.col("is_enabled").cast("boolean").alias("is_enabled"),
        F.col("is_hard_block").cast("boolean").alias("is_hard_block"),
        "description",
    )


def analysis_shape(analyses: DataFrame) -> DataFrame:
    columns = ["analysis_id", "event_id", "rule_code", "rule_score", "details"]
    return analyses.select(*columns, *[c for c in ("rule_type", "weight") if c in analyses.columns])


def response_shape(traffic: DataFrame, scored: DataFrame, enforced: DataFrame | None = None) -> DataFrame:
    """Response record with its evaluation and, where given, the enforcement of its request."""
    out = traffic.select(
        "request_id",
        X.iso_z(F.col("timestamp")).alias("timestamp"),
        F.lit("RESPONSE").alias("type"),
        "status_code",
        "url",
        F.col("resp_headers").alias("headers"),
        F.col("resp_body").alias("body"),
    )
    verdict = scored.select(
        "request_id",
        F.struct(
            "decision", "risk_score", "hard_block_triggered", "stage_b_required", "rule_results"
        ).alias("evaluation"),
    )
    out = out.join(verdict, "request_id", "left")
    if enforced is not None:
        record = enforced.select(
            "request_id", F.struct("decision", "reason", "source").alias("request_enforcement")
        )
        out = out.join(record, "request_id", "left")
    return out
