"""Row-level validation of JSON payloads: each job splits a table into valid and rejected rows.

A payload is parsed once into a variant, so missing fields, nulls and wrong types stay apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import text as X
from tidegate.session import checkpoint
from tidegate.sources import dims

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"


@dataclass(frozen=True)
class Field:
    """One field of a parsed payload: `bound` holds its type name, its variant value and, of a string, its text."""

    bound: Column

    def _get(self, kind: str) -> Column:
        return F.try_variant_get(self.bound["value"], "$", kind)

    @property
    def kind(self) -> Column:
        return self.bound["kind"]

    @property
    def present(self) -> Column:
        return self.kind != "MISSING"

    @property
    def given(self) -> Column:
        """Present and not null."""
        return ~self.kind.isin("MISSING", "VOID")

    @property
    def is_text(self) -> Column:
        return self.kind == "STRING"

    @property
    def is_object(self) -> Column:
        return self.kind.startswith("OBJECT")

    @property
    def is_boolean(self) -> Column:
        return self.kind == "BOOLEAN"

    @property
    def text(self) -> Column:
        return self.bound["text"]

    @property
    def any_text(self) -> Column:
        return self._get("string")

    @property
    def boolean(self) -> Column:
        return F.when(self.is_boolean, self._get("boolean"))

    @property
    def mapping(self) -> Column:
        return F.when(self.is_object, self._get("map<string,string>"))

    def clean(self, max_length: int | None = None) -> Column:
        return X.clean_string(self.text, max_length)

    def number(self, minimum: float | None = None, maximum: float | None = None) -> Column:
        readable = ~self.is_text | self.text.rlike(_NUMBER)
        return F.when(readable, X.bounded_float(self._get("double"), minimum, maximum))

    @property
    def positive_int(self) -> Column:
        readable = ~self.is_text | self.text.rlike(_INTEGER)
        return F.when(readable, X.positive_int(self._get("long")))

    @property
    def timestamp(self) -> Column:
        return X.parse_iso(self.text)


Payload = Callable[[str], Field]


@dataclass(frozen=True)
class Spec:
    """Checks of one table: the error of a row (null when valid) and its typed columns."""

    fields: tuple[str, ...]
    error: Callable[[Payload], Column]
    columns: Callable[[Payload], dict[str, Column]]
    not_object: str = "Invalid JSON body"


def checked(df: DataFrame, spec: Spec, payload: str = "payload") -> DataFrame:
    """All rows in one pass: `error` in place of the payload, and `_row`, the typed columns, null beside an error.

    Projections, not functions of arrays, read the fields, so that they run as compiled code and share what they have
    in common. The outer generator keeps later filters above the parse, and the optimizer infers none below it.
    """

    def field(name: str) -> Column:
        value = F.try_variant_get("_v", f"$.{name}", "variant")
        kind = F.coalesce(F.schema_of_variant(value), F.lit("MISSING"))
        text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        return F.struct(kind.alias("kind"), value.alias("value"), text.alias("text")).alias(f"_f_{name}")

    def of(name: str) -> Field:
        return Field(F.col(f"_f_{name}"))

    # the JVM leaves methods of over 8,000 bytes uncompiled, and the checks of a payload are longer in one method
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    kept = [c for c in df.columns if c != payload]
    fields = [f"_f_{n}" for n in spec.fields]
    parsed = df.select(*kept, F.try_parse_json(payload).alias("_v"))
    whole = F.coalesce(F.schema_of_variant("_v"), F.lit("")).startswith("OBJECT")
    read = parsed.select(*kept, whole.alias("_whole"), *[field(n) for n in spec.fields])
    error = F.when(~F.col("_whole"), F.lit(spec.not_object)).otherwise(spec.error(of))
    judged = read.select(*kept, F.struct(error.alias("error"), *fields).alias("_judged"))
    bound = judged.select(*kept, F.inline_outer(F.array("_judged")))
    row = F.struct(*[c.alias(n) for n, c in spec.columns(of).items()])
    return bound.select(*kept, "error", F.when(F.col("error").isNull(), row).alias("_row"))


def split_valid(df: DataFrame, spec: Spec, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): valid rows get the typed columns, rejected ones their `error`; a row is parsed once a side."""
    judged = checked(df.withColumn("_read", F.col(payload)), spec, "_read")
    valid = judged.filter("error is null").select(*[c for c in df.columns if c != payload], "_row.*")
    return valid, judged.filter("error is not null").select(*df.columns, "error")


def _first(*checks: tuple[Column, str]) -> Column:
    """Message of the first failed check."""
    return F.coalesce(*[F.when(bad, F.lit(message)) for bad, message in checks])


def _not_in(field: Field, allowed: list[str]) -> Column:
    return ~F.coalesce(field.text.isin(allowed), F.lit(False))


# ------------------------------------------------------------------ Q1 traffic
def _traffic_error(p: Payload) -> Column:
    names = ("url", "method", "headers", "body")
    missing = F.concat_ws(", ", *[F.when(~p(n).present, F.lit(n)) for n in names])
    env, ts = p("environment"), p("timestamp")
    bad_env = env.given & ~F.coalesce(F.lower(env.clean()).isin(dims.ENVIRONMENTS), F.lit(False))
    listed = F.when(missing != "", F.concat(F.lit("Missing required fields: "), missing))
    return F.coalesce(
        listed,
        _first(
            (p("url").clean().isNull(), "'url' must be a non-empty string"),
            (p("method").clean().isNull(), "'method' must be a non-empty string"),
            (~p("headers").is_object, "'headers' must be an object"),
            (ts.given & ts.timestamp.isNull(), "'timestamp' must be a valid ISO-8601 datetime"),
            (bad_env, "'environment' must be one of: prod, test"),
            (
                p("session_id").given & p("session_id").positive_int.isNull(),
                "'session_id' must be a positive integer",
            ),
            (
                p("agent_name").given & p("agent_name").clean().isNull(),
                "'agent_name' must be a non-empty string when provided",
            ),
        ),
    )


def _traffic_columns(p: Payload) -> dict[str, Column]:
    env = p("environment")
    return {
        "url": p("url").clean(),
        "method": F.upper(p("method").clean()),
        "req_headers": p("headers").mapping,
        "body": F.coalesce(p("body").any_text, F.lit("")),
        "timestamp": F.coalesce(p("timestamp").timestamp, F.current_timestamp()),
        "environment": F.coalesce(F.lower(env.clean()), F.lit(dims.DEFAULT_ENVIRONMENT)),
        "environment_given": env.given,
        "session_id": p("session_id").positive_int,
        "agent_name": p("agent_name").clean(),
    }


_TRAFFIC_FIELDS = (
    "url", "method", "headers", "body", "timestamp", "environment", "session_id", "agent_name",
)
TRAFFIC = Spec(_TRAFFIC_FIELDS, _traffic_error, _traffic_columns, "JSON request body is required")


# ------------------------------------------------------------------ Q3 events
def _event_error(p: Payload) -> Column:
    headers = p("headers")
    faults = F.concat_ws(
        ", ",
        F.when(p("url").clean().isNull(), F.lit("url")),
        F.when(~headers.given, F.lit("headers")).when(~headers.is_object, F.lit("headers must be an object")),
        F.when(p("method").clean(16).isNull(), F.lit("method")),
        F.when(p("timestamp").timestamp.isNull(), F.lit("timestamp")),
        F.when(_not_in(p("guard_action"), dims.GUARD_ACTIONS), F.lit("guard_action")),
        F.when(p("risk_score").number(0, 1).isNull(), F.lit("risk_score")),
    )
    return F.when(faults != "", F.concat(F.lit("Invalid payload: "), faults))


def _event_columns(p: Payload) -> dict[str, Column]:
    return {
        "url": p("url").clean(),
        "headers": p("headers").mapping,
        "http_method": F.upper(p("method").clean(16)),
        "timestamp": p("timestamp").timestamp,
        "guard_action": p("guard_action").text,
        "risk_score": p("risk_score").number(0, 1),
    }


_EVENT_FIELDS = ("url", "headers", "method", "timestamp", "guard_action", "risk_score")
EVENTS = Spec(_EVENT_FIELDS, _event_error, _event_columns)


# ------------------------------------------------------------------ Q4 rules
_RULE_FIELDS = (
    "rule_code", "weight", "rule_type", "compute_class", "is_enabled", "is_hard_block", "description",
)


def _rule_error(p: Payload) -> Column:
    description = p("description")
    return _first(
        *[(~p(n).present, f"Missing {n}") for n in _RULE_FIELDS],
        (p("rule_code").clean(30).isNull(), "Invalid rule_code"),
        (p("weight").number(0).isNull(), "Invalid weight"),
        (_not_in(p("rule_type"), dims.RULE_TYPES), "Invalid rule_type"),
        (_not_in(p("compute_class"), dims.COMPUTE_CLASSES), "Invalid compute_class"),
        (~p("is_enabled").is_boolean, "Invalid is_enabled"),
        (~p("is_hard_block").is_boolean, "Invalid is_hard_block"),
        (description.given & description.clean(255).isNull(), "Invalid description"),
    )


def _rule_columns(p: Payload) -> dict[str, Column]:
    return {
        "rule_code": p("rule_code").clean(30),
        "weight": p("weight").number(0),
        "rule_type": p("rule_type").text,
        "compute_class": p("compute_class").text,
        "is_enabled": p("is_enabled").boolean,
        "is_hard_block": p("is_hard_block").boolean,
        "description": p("description").clean(255),
    }


RULES = Spec(_RULE_FIELDS, _rule_error, _rule_columns)


def split_new_rules(
    df: DataFrame, rules: DataFrame, order: str, payload: str = "payload"
) -> tuple[DataFrame, DataFrame]:
    """Q4 with the key: a code that exists, or that an earlier valid row has taken, is rejected.

    Valid rows are met several times, so they are written once; they have no payload any more.
    """
    valid, rejected = split_valid(df, RULES, payload)
    valid = checkpoint(valid)
    first = valid.groupBy("rule_code").agg(F.min(order).alias("_first"))
    state = valid.join(first, "rule_code").join(
        rules.select("rule_code", F.lit(True).alias("_known")), "rule_code", "left"
    )
    taken = F.coalesce("_known", F.lit(False)) | (F.col(order) != F.col("_first"))
    duplicate = state.filter(taken).select(order).withColumn("_dup", F.lit("rule_code already exists"))
    refused = df.join(duplicate, order).withColumnRenamed("_dup", "error").select(*df.columns, "error")
    return state.filter(~taken).select(*valid.columns), rejected.unionByName(refused)


# ------------------------------------------------------------------ Q5 rule analyses
def _analysis_error(p: Payload) -> Column:
    score = p("rule_score")
    return _first(
        (p("event_id").positive_int.isNull(), "Invalid event_id"),
        (p("rule_code").clean(30).isNull(), "Invalid rule_code"),
        (score.given & score.number(0, 1).isNull(), "Invalid rule_score"),
        (p("details").clean(255).isNull(), "Invalid details"),
    )


def _analysis_columns(p: Payload) -> dict[str, Column]:
    return {
        "event_id": p("event_id").positive_int,
        "rule_code": p("rule_code").clean(30),
        "rule_score": p("rule_score").number(0, 1),
        "details": p("details").clean(255),
    }


ANALYSES = Spec(("event_id", "rule_code", "rule_score", "details"), _analysis_error, _analysis_columns)


# ------------------------------------------------------------------ Q6 sessions
def _session_error(p: Payload) -> Column:
    return _first(
        (p("start_time").timestamp.isNull(), "Invalid or missing start_time"),
        (p("agent_name").clean(20).isNull(), "Missing agent_name"),
        (_not_in(p("environment"), dims.ENVIRONMENTS), "Invalid environment value"),
    )


def _session_columns(p: Payload) -> dict[str, Column]:
    return {
        "start_time": p("start_time").timestamp,
        "agent_name": p("agent_name").clean(20),
        "environment": p("environment").text,
    }


def _session_end_error(p: Payload) -> Column:
    return _first(
        (~p("end_time").present, "end_time is required"),
        (p("end_time").timestamp.isNull(), "Invalid end_time"),
    )


SESSIONS = Spec(("start_time", "agent_name", "environment"), _session_error, _session_columns)
SESSION_ENDS = Spec(("end_time",), _session_end_error, lambda p: {"end_time": p("end_time").timestamp})
RULE_FLAGS = Spec(
    ("is_enabled",),
    lambda p: _first((~p("is_enabled").is_boolean, "Invalid is_enabled")),
    lambda p: {"is_enabled": p("is_enabled").boolean},
)
