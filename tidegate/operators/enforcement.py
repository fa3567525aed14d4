"""What happens to a request, given the decision that came back for it or did not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKED = "The guard blocked the request before it reached the external destination."
UNAVAILABLE = "The guard blocked the request because the decision service is unavailable."
INVALID = "The guard blocked the request because the decision service returned an invalid response."
OPEN = "The guard allowed the request because fail-open mode is enabled."
WARNED = "The guard marked the request as warn and allowed it to continue."
APPROVED = "The guard approved the request."

FAILURES = ("backend_error", "backend_timeout", "backend_unreachable")


def block_detail(rule_results: Column) -> Column:
    """First explanation of a triggered hard-block rule, else the first three of triggered rules."""
    told = F.filter(
        rule_results,
        lambda r: r["triggered"] & (r["explanation"] != "") & ~r["explanation"].startswith("Skipped"),
    )
    hard = F.try_element_at(F.filter(told, lambda r: r["hard_block"]), F.lit(1))["explanation"]
    few = F.array_join(F.transform(F.slice(told, 1, 3), lambda r: r["explanation"]), "; ")
    return F.coalesce(hard, F.nullif(few, F.lit("")))


def block_reason(rule_results: Column) -> Column:
    """R15."""
    detail = block_detail(rule_results)
    return F.when(
        detail.isNotNull(), F.concat(F.lit(BLOCKED + "\n\nReason: "), detail)
    ).otherwise(F.lit(BLOCKED))


def enforcement(
    traffic: DataFrame, decisions: DataFrame, failure_mode: str = "fail_closed", passive: bool = False
) -> DataFrame:
    """Decision, reason, source, status_code (null: the request goes on).

    `decisions` has request_id, decision, rule_results and `error` (null, timeout, unreachable, or
    anything else for an unusable answer), and may have a boolean `passive_mode` of its own. A request
    without a row counts as unreachable. In passive mode an answered block is recorded and not
    applied; failures still follow the failure mode.
    """
    own_mode = F.col("passive_mode") if "passive_mode" in decisions.columns else F.lit(None).cast("boolean")
    answered = decisions.select(
        "request_id",
        "decision",
        "rule_results",
        "error",
        F.coalesce(own_mode, F.lit(passive)).alias("passive"),
        F.lit(True).alias("came_back"),
    )
    return enforced(traffic.select("request_id").join(answered, "request_id", "left"), failure_mode)


def enforced(answers: DataFrame, failure_mode: str = "fail_closed", *keep: str) -> DataFrame:
    """R14 over rows that hold request and answer together: request_id, decision, rule_results, `error`,
    booleans `passive` and `came_back`. Columns of `keep` go along."""
    if failure_mode not in ("fail_closed", "fail_open"):
        raise ValueError("failure_mode is fail_closed or fail_open")
    joined = answers.withColumn("answer", F.lower("decision"))
    valid = F.coalesce(
        F.col("error").isNull() & F.col("answer").isin("allow", "warn", "block"), F.lit(False)
    )
    source = (
        F.when(F.col("came_back").isNull() | (F.col("error") == "unreachable"), F.lit("backend_unreachable"))
        .when(F.col("error") == "timeout", F.lit("backend_timeout"))
        .when(~valid, F.lit("backend_error"))
        .otherwise(F.lit("backend"))
    )
    if failure_mode == "fail_open":
        failed, failed_reason, failed_status = F.lit("allow"), F.lit(OPEN), F.lit(None).cast("int")
    else:
        failed, failed_status = F.lit("block"), F.lit(503)
        failed_reason = F.when(F.col("source") == "backend_error", F.lit(INVALID)).otherwise(F.lit(UNAVAILABLE))
    ok = F.col("source") == "backend"
    reason = (
        F.when(F.col("answer") == "block", block_reason(F.col("rule_results")))
        .when(F.col("answer") == "warn", F.lit(WARNED))
        .otherwise(F.lit(APPROVED))
    )
    blocks = ~F.col("passive") & (F.col("answer") == "block")
    return joined.withColumn("source", source).select(
        "request_id",
        F.when(ok, F.col("answer")).otherwise(failed).alias("decision"),
        F.when(ok, reason).otherwise(failed_reason).alias("reason"),
        "source",
        F.when(ok, F.when(blocks, F.lit(403))).otherwise(failed_status).alias("status_code"),
        F.when(ok, F.col("rule_results")).alias("rule_results"),
        *keep,
    )
