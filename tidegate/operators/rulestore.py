"""Rule table maintenance and referential checks; every job yields a new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.rules import RuleBook


def registry_rules(spark, book: RuleBook | None = None) -> DataFrame:
    """The registered rules as rows of the rules table."""
    rows = [
        (r.rule_id, r.weight, r.rule_type, r.compute_class, True, r.hard_block, r.description[:255])
        for r in (book or RuleBook()).rules
    ]
    from tidegate import schemas

    return spark.createDataFrame(rows, schemas.RULES)


def rules_from_results(results: DataFrame, book: RuleBook | None = None) -> DataFrame:
    """Rule rows for the rules that gave results.

    Registered rules have their weight, compute class and description; for others the weight is zero
    and the description is an explanation, both cut to 255 characters.
    """
    seen = results.groupBy(F.col("rule_id").alias("rule_code")).agg(
        F.min("rule_type").alias("rule_type"), F.bool_or("hard_block").alias("is_hard_block"), F.min("explanation").alias("told")
    )
    known = registry_rules(results.sparkSession, book).select("rule_code", "weight", "compute_class", "description")
    return seen.join(known, "rule_code", "left").select(
        "rule_code",
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        "rule_type",
        F.coalesce("compute_class", F.lit("cheap")).alias("compute_class"),
        F.lit(True).alias("is_enabled"),
        "is_hard_block",
        F.left(F.coalesce("description", "told"), F.lit(255)).alias("description"),
    )


def register_missing_rules(rules: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds the rules that are not there yet; existing rows stay as they are."""
    new = candidates.join(rules.select("rule_code"), "rule_code", "left_anti")
    return rules.unionByName(new.select(*rules.columns))


def set_rules_enabled(rules: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, unknown codes). Changes carry rule_code and a boolean is_enabled; a null one fails the job."""
    if dict(changes.dtypes)["is_enabled"] != "boolean":
        raise ValueError("Invalid is_enabled")
    flags = changes.select("rule_code", F.coalesce("is_enabled", F.raise_error(F.lit("Invalid is_enabled"))).alias("new_flag"))
    snapshot = (
        rules.join(flags, "rule_code", "left")
        .withColumn("is_enabled", F.coalesce("new_flag", "is_enabled"))
        .select(*rules.columns)
    )
    unknown = changes.select("rule_code").join(rules.select("rule_code"), "rule_code", "left_anti")
    return snapshot, unknown


def with_enablement(codes: DataFrame, rules: DataFrame) -> DataFrame:
    """J12 as a join: a rule that the table lacks counts as enabled."""
    flags = rules.select("rule_code", F.col("is_enabled").alias("flag"))
    return (
        codes.join(flags, "rule_code", "left")
        .withColumn("is_enabled", F.coalesce("flag", F.lit(True)))
        .drop("flag")
    )


def orphan_events(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events without a session."""
    return events.join(sessions.select("session_id"), "session_id", "left_anti").withColumn(
        "error", F.lit("Session not found")
    )


def orphan_analyses(analyses: DataFrame, events: DataFrame, rules: DataFrame) -> DataFrame:
    """Analyses without an event or, where the event exists, without a rule."""
    there = events.select("event_id", F.lit(True).alias("_event")).distinct()
    known = rules.select("rule_code", F.lit(True).alias("_rule")).distinct()
    error = F.when(F.col("_event").isNull(), F.lit("Referenced event does not exist")).when(
        F.col("_rule").isNull(), F.lit("Referenced rule does not exist")
    )
    found = analyses.join(there, "event_id", "left").join(known, "rule_code", "left").withColumn("error", error)
    return found.where("error is not null").select(*analyses.columns, "error")
