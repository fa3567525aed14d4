from __future__ import annotations

import json

import pytest

from tidegate.operators import enforcement as E
from tidegate.operators import quality as Q
from tidegate.operators import rulestore as K

GOOD = {"url": " https://a.com ", "method": "post", "headers": {"A": "1"}, "body": "x", "timestamp": "2024-01-01T00:00:00Z"}


def check(spark, spec, *payloads):
    rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    valid, rejected = Q.split_valid(spark.createDataFrame(rows, "n long, payload string"), spec)
    return {r["n"]: r for r in valid.collect()}, {r["n"]: r["error"] for r in rejected.collect()}


def test_traffic(spark):
    bad = [
        ("[1]", "JSON request body is required"), (None, "JSON request body is required"), ("{", "JSON request body is required"),
        ({"url": "u"}, "Missing required fields: method, headers, body"),
        (GOOD | {"url": None}, "'url' must be a non-empty string"),
        (GOOD | {"method": 5}, "'method' must be a non-empty string"),
        (GOOD | {"headers": "h"}, "'headers' must be an object"),
        (GOOD | {"timestamp": "x"}, "'timestamp' must be a valid ISO-8601 datetime"),
        (GOOD | {"timestamp": 5}, "'timestamp' must be a valid ISO-8601 datetime"),
        (GOOD | {"environment": "dev"}, "'environment' must be one of: prod, test"),
        (GOOD | {"session_id": 0}, "'session_id' must be a positive integer"),
        (GOOD | {"session_id": "1.5"}, "'session_id' must be a positive integer"),
        (GOOD | {"agent_name": ""}, "'agent_name' must be a non-empty string when provided"),
    ]
    valid, rejected = check(spark, Q.TRAFFIC, *[p for p, _ in bad], GOOD, GOOD | {"session_id": "7", "environment": " Test ", "body": None, "timestamp": None})
    assert rejected == {i: m for i, (_, m) in enumerate(bad)}
    plain, full = valid[len(bad)], valid[len(bad) + 1]
    assert (plain["url"], plain["method"], plain["req_headers"], plain["environment"]) == ("https://a.com", "POST", {"A": "1"}, "prod")
    assert plain["environment_given"] is False and plain["session_id"] is None
    assert (full["session_id"], full["environment"], full["body"]) == (7, "test", "")
    assert full["timestamp"] is not None


EVENT = {"url": "u", "headers": {}, "method": "get", "timestamp": "2024-01-01T00:00:00Z", "guard_action": "Allow", "risk_score": 0.5}


def test_events_list_all_faults(spark):
    valid, rejected = check(
        spark, Q.EVENTS, EVENT, {}, EVENT | {"headers": [], "risk_score": 1.5}, EVENT | {"risk_score": "nan"},
        EVENT | {"risk_score": "0.5", "method": "x" * 17}, EVENT | {"risk_score": "0.5"},
    )
    assert rejected == {
        1: "Invalid payload: url, headers, method, timestamp, guard_action, risk_score",
        2: "Invalid payload: headers must be an object, risk_score",
        3: "Invalid payload: risk_score",
        4: "Invalid payload: method",
    }
    assert valid[0]["http_method"] == "GET" and valid[5]["risk_score"] == 0.5


RULE = {
    "rule_code": "r", "weight": 1, "rule_type": "semantic", "compute_class": "cheap", "is_enabled": True,
    "is_hard_block": False, "description": None,
}


@pytest.mark.parametrize(
    "change, message",
    [
        ({"rule_code": "x" * 31}, "Invalid rule_code"), ({"weight": -0.1}, "Invalid weight"), ({"weight": "inf"}, "Invalid weight"),
        ({"rule_type": "x"}, "Invalid rule_type"), ({"compute_class": None}, "Invalid compute_class"),
        ({"is_enabled": 1}, "Invalid is_enabled"), ({"is_hard_block": "true"}, "Invalid is_hard_block"),
        ({"description": "d" * 256}, "Invalid description"), ({"description": 5}, "Invalid description"), ({}, None),
    ],
)
def test_rules(spark, change, message):
    assert check(spark, Q.RULES, RULE | change)[1].get(0) == message


def test_missing_rule_field_and_duplicates(spark):
    short = {k: v for k, v in RULE.items() if k != "is_enabled"}
    assert check(spark, Q.RULES, short)[1] == {0: "Missing is_enabled"}
    rows = [(1, json.dumps(RULE)), (2, json.dumps(RULE | {"weight": 2})), (3, json.dumps(RULE | {"rule_code": "typosquatting"}))]
    valid, rejected = Q.split_new_rules(spark.createDataFrame(rows, "n long, payload string"), K.registry_rules(spark), "n")
    assert [(r["n"], r["weight"]) for r in valid.collect()] == [(1, 1.0)]
    assert {r["n"]: r["error"] for r in rejected.collect()} == {2: "rule_code already exists", 3: "rule_code already exists"}


def test_analyses_and_sessions(spark):
    line = {"event_id": "3", "rule_code": " r ", "rule_score": None, "details": "d"}
    valid, rejected = check(spark, Q.ANALYSES, line, line | {"event_id": 0}, line | {"rule_score": 2}, line | {"details": " "})
    assert (valid[0]["event_id"], valid[0]["rule_code"], valid[0]["rule_score"]) == (3, "r", None)
    assert rejected == {1: "Invalid event_id", 2: "Invalid rule_score", 3: "Invalid details"}
    session = {"start_time": "2024-01-01", "agent_name": "a", "environment": "test"}
    _, rejected = check(spark, Q.SESSIONS, session, session | {"start_time": 1}, session | {"agent_name": "x" * 21}, session | {"environment": "Test"})
    assert rejected == {1: "Invalid or missing start_time", 2: "Missing agent_name", 3: "Invalid environment value"}
    assert check(spark, Q.SESSION_ENDS, {}, {"end_time": None}, {"end_time": "2024-01-01"})[1] == {0: "end_time is required", 1: "Invalid end_time"}
    assert check(spark, Q.RULE_FLAGS, {"is_enabled": True}, {"is_enabled": 1})[1] == {1: "Invalid is_enabled"}


RESULT = "array<struct<rule_id:string,rule_type:string,score:double,hard_block:boolean,explanation:string,triggered:boolean>>"


def result(rule, hard, why, hit=True):
    return (rule, "deterministic", 1.0 if hit else 0.0, hard, why, hit)


def enforced(spark, decision, results=None, error=None, **options):
    traffic = spark.createDataFrame([(1,), (2,)], "request_id long")
    rows = spark.createDataFrame(
        [(1, decision, results, error)], f"request_id long, decision string, rule_results {RESULT}, error string"
    )
    return {r["request_id"]: r for r in E.enforcement(traffic, rows, **options).collect()}


def test_enforcement(spark):
    hard = [result("a", False, "soft one"), result("unencrypted_connection", True, "Connection is unencrypted ('http://')")]
    rows = enforced(spark, "BLOCK", hard)
    assert (rows[1]["decision"], rows[1]["source"], rows[1]["status_code"]) == ("block", "backend", 403)
    assert rows[1]["reason"] == E.BLOCKED + "\n\nReason: Connection is unencrypted ('http://')"
    assert (rows[2]["decision"], rows[2]["source"], rows[2]["status_code"], rows[2]["reason"]) == ("block", "backend_unreachable", 503, E.UNAVAILABLE)
    soft = [result(f"r{i}", False, f"why {i}", hit=i != 1) for i in range(5)]
    assert enforced(spark, "block", soft)[1]["reason"].endswith("Reason: why 0; why 2; why 3")
    assert enforced(spark, "block", [])[1]["reason"] == E.BLOCKED
    assert enforced(spark, "block", None)[1]["reason"] == E.BLOCKED
    assert enforced(spark, "block", hard, passive=True)[1]["status_code"] is None
    allowed = enforced(spark, "allow", [])[1]
    assert (allowed["reason"], allowed["status_code"]) == (E.APPROVED, None)
    odd = enforced(spark, "maybe")[1]
    assert (odd["source"], odd["reason"], odd["status_code"]) == ("backend_error", E.INVALID, 503)
    late = enforced(spark, None, error="timeout", failure_mode="fail_open")[1]
    assert (late["decision"], late["source"], late["reason"], late["status_code"]) == ("allow", "backend_timeout", E.OPEN, None)
    with pytest.raises(ValueError):
        enforced(spark, "allow", failure_mode="open")


def test_payloads_are_checked_in_compiled_projections(spark):
    """Functions of arrays are interpreted row by row; nothing of the check hides in one, and no filter repeats the parse."""
    df = spark.createDataFrame([(1, "{}")], "n long, payload string").repartition(2)
    for spec in (Q.TRAFFIC, Q.EVENTS, Q.RULES, Q.ANALYSES, Q.SESSIONS, Q.SESSION_ENDS, Q.RULE_FLAGS):
        for found in (Q.checked(df, spec), *Q.split_valid(df, spec)):
            plan = found._jdf.queryExecution().executedPlan().toString().lower()
            assert "lambda" not in plan and plan.count("parsejson") + plan.count("parse_json") == 1


@pytest.mark.parametrize("text", [
    "2024-01-02T03:04:05Z", "2024-01-02 03:04:05.1234567+05:30", "2024-01-02T03:04:05-0530", "2024-01-02T03:04:05,5Z", "2024-01-02T03:04",
    " 2024-01-02T03:04:05.5Z\n", "2024-02-30T03:04:05Z", "2024-01-02T24:04:05Z", "2024-01-02T03:04:60+00:00", "2024-01-02T03:04:05+19:00", "2024-01-02", "x",
])
def test_whole_times_are_read_as_the_others(spark, text):
    """Times with seconds and an offset take a short way; it gives what the parts give."""
    import re

    from tidegate.functions import text as X

    found = re.fullmatch(X._ISO, text.strip())
    want = None
    if found:
        day, hours, minutes, seconds, offset = (g or d for g, d in zip(found.groups(), ("", "00", "00", "00", "Z")))
        offset = offset.replace("Z", "+00:00") if ":" in offset or offset == "Z" else offset[:3] + ":" + offset[3:]
        full = f"{day}T{hours}:{minutes}:{seconds.replace(',', '.')}{offset}"
        want = spark.sql("SELECT try_to_timestamp(:t)", {"t": full}).first()[0]
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.parse_iso(df.t)).first()[0] == want


def test_orphans_are_told_once(spark):
    """Events and rules that come twice, keys that are null."""
    analyses = spark.createDataFrame([(1, 5, "a"), (2, 6, "a"), (3, 5, "b"), (4, None, "a"), (5, 5, None), (5, 5, None)], "analysis_id long, event_id long, rule_code string")
    events = spark.createDataFrame([(5,), (5,), (None,)], "event_id long")
    rules = spark.createDataFrame([("a",), ("a",), (None,)], "rule_code string")
    got = sorted((r["analysis_id"], r["error"].split()[1]) for r in K.orphan_analyses(analyses, events, rules).collect())
    assert got == [(2, "event"), (3, "rule"), (4, "event"), (5, "rule"), (5, "rule")]
