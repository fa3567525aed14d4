"""Audit sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import text as X
from tidegate.operators.rules import rule_results
from tidegate.session import checkpoint

DECISION_FIELDS = [
    "timestamp", "agent", "environment", "session_id", "event_id", "url", "method", "risk_score",
    "decision", "hard_block_triggered", "stage_b_required", "rule_count", "triggered_rule_count",
]


def audit_events(scored: DataFrame) -> DataFrame:
    """One `events` row per scored and attributed request."""
    return scored.select(
        F.col("request_id").alias("event_id"),
        "session_id",
        "timestamp",
        "url",
        X.guard_action(F.col("decision")).alias("guard_action"),
        "risk_score",
        F.upper("method").alias("http_method"),
        X.encode_headers(F.col("req_headers")).alias("headers_json"),
    )


def audit_analyses(scored: DataFrame) -> DataFrame:
    """One `rules_analysis` row per rule result; the id is made of event and rule ordinal."""
    return rule_results(scored).select(
        (F.col("request_id") * 100 + F.col("ordinal")).alias("analysis_id"),
        F.col("request_id").alias("event_id"),
        F.col("rule_id").alias("rule_code"),
        F.col("score").alias("rule_score"),
        F.col("explanation").alias("details"),
    )


def write_audit_tables(scored: DataFrame, path: str, mode: str = "append") -> None:
    """Writes `events` (by day) and `rules_analysis` below `path`.

    The thin event rows are rebalanced by day before the write, so that a day gets few files and a
    busy day is split over several tasks.
    """
    kept = checkpoint(scored)  # thin rows, read by both sinks
    (
        audit_events(kept)
        .withColumn("event_date", F.to_date("timestamp"))
        .hint("rebalance", "event_date")
        .write.mode(mode)
        .option("maxRecordsPerFile", 5_000_000)
        .partitionBy("event_date")
        .parquet(f"{path}/events")
    )
    audit_analyses(kept).write.mode(mode).option("maxRecordsPerFile", 20_000_000).parquet(f"{path}/rules_analysis")


def decision_records(scored: DataFrame) -> DataFrame:
    """Audit records of decisions (sink schema A)."""
    return scored.select(
        X.iso_z(F.col("timestamp")).alias("timestamp"),
        F.col("agent_name").alias("agent"),
        "environment",
        "session_id",
        F.col("request_id").alias("event_id"),
        "url",
        F.upper("method").alias("method"),
        "risk_score",
        "decision",
        "hard_block_triggered",
        "stage_b_required",
        F.size("rule_results").alias("rule_count"),
        F.size(F.filter("rule_results", lambda r: r["triggered"])).alias("triggered_rule_count"),
    )


def sorted_json(df: DataFrame) -> Column:
    """One JSON object per row, keys in order. Decision records show all keys, others leave nulls out."""
    whole = set(df.columns) == set(DECISION_FIELDS)
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": str(not whole).lower()})


def audit_lines(*records: DataFrame) -> DataFrame:
    """Records of any schema as JSON lines in one `value` column."""
    lines = [r.select(sorted_json(r).alias("value")) for r in records]
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    return out


def write_audit_log(records: DataFrame | list[DataFrame], path: str, mode: str = "append") -> None:
    """Writes the audit log."""
    frames = records if isinstance(records, list) else [records]
    audit_lines(*frames).write.mode(mode).text(path)
