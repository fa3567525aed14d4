"""Session jobs against brute force, with one agent or session holding most rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from tidegate.operators import reports as A
from tidegate.operators import rulestore as K
from tidegate.operators import sessions as S

START = datetime(2024, 1, 1)


def moment(rng, days=6):
    return START + timedelta(seconds=rng.randint(0, days * 86_400))


def moves_of(seed, n=300):
    rng = random.Random(seed)
    agents = ["hot"] * 6 + ["a", "b!", None]
    return [
        (i, moment(rng), rng.choice(["start", "stop", "start", "request"]), rng.choice(["prod", "prod", "test", None]), rng.choice(agents))
        for i in range(n)
    ]


def rotate(moves):
    """Sessions one move at a time."""
    clean = {"b!": "b", None: "browserOS"}
    open_, done = {}, []
    for i, ts, action, env, agent in sorted(moves, key=lambda m: (m[1], m[0])):
        key = (clean.get(agent, agent), env or "prod")
        if action in ("start", "stop") and key in open_:
            done.append((*open_.pop(key), ts, S.SUPERSEDED if action == "start" else S.STOPPED))
            replaced = done[-1][0] if action == "start" else None
        else:
            replaced = None
        if action == "start":
            open_[key] = (i, ts, *key, replaced)
    return sorted([*done, *((*o, None, None) for o in open_.values())], key=lambda s: s[0])


LIFECYCLE = "event_id long, ts timestamp, action string, environment string, agent_name string"


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_rotation(spark, parts):
    moves = moves_of(1)
    got = S.rotate_sessions(spark.createDataFrame(moves, LIFECYCLE), parts).orderBy("session_id").collect()
    shown = [
        (r["session_id"], r["start_time"], r["agent_name"], r["environment"], r["replaced_session_id"], r["end_time"], r["end_reason"])
        for r in got
    ]
    assert shown == rotate(moves)


def test_stop_without_session_is_a_no_op(spark):
    moves = [(1, START, "stop", "prod", "a"), (2, START + timedelta(hours=1), "start", "prod", "a")]
    rows = S.rotate_sessions(spark.createDataFrame(moves, LIFECYCLE)).collect()
    assert [(r["session_id"], r["end_time"]) for r in rows] == [(2, None)]


@pytest.mark.parametrize("parts", [1, 4, 25])
def test_open_session_equals_brute_force(spark, parts):
    rng = random.Random(2)
    sessions = []
    for i in range(120):
        start = moment(rng)
        end = None if rng.random() < 0.05 else start + timedelta(seconds=rng.choice([0, 5, 60, 900, 90_000]))
        sessions.append((i, None, start, end, rng.choice(["prod", "prod", "test"]), rng.choice(["hot", "hot", "a"])))
    asked = [(i, moment(rng, 7), rng.choice(["prod", "test"]), rng.choice(["hot", "a", "none"])) for i in range(500)]
    asked += [(1000 + i, s[2], s[4], s[5]) for i, s in enumerate(sessions)]
    asked += [(2000 + i, s[3], s[4], s[5]) for i, s in enumerate(sessions) if s[3]]
    got = S.open_session_at(
        spark.createDataFrame(asked, "event_id long, ts timestamp, environment string, agent_name string"),
        spark.createDataFrame(sessions, "session_id long, user_id long, start_time timestamp, end_time timestamp, environment string, agent_name string"),
        parts,
    )
    want = {}
    for i, ts, env, agent in asked:
        hits = [s[0] for s in sessions if (s[4], s[5]) == (env, agent) and s[2] <= ts and (s[3] is None or ts < s[3])]
        want[i] = max(hits, default=None)
    assert {r["event_id"]: r["open_session_id"] for r in got.collect()} == want


@pytest.mark.parametrize("parts, depth, span", [(1, 3, 6), (12, 4, 6), (12, 2, 0)])
def test_context_equals_brute_force(spark, parts, depth, span):
    """One session holds most rows; with a span of zero all of its rows have one time."""
    rng = random.Random(4)
    events = [
        (i, rng.choice([1, 1, 1, 1, 2, 3]), moment(rng, span), f"https://h{rng.randint(0, 9)}.com/{i}", rng.choice([True, False, None])) for i in range(400)
    ]
    rows = spark.createDataFrame(events, "event_id long, session_id long, timestamp timestamp, url string, sensitive boolean")
    context = S.session_context(rows, parts)
    got = {r["event_id"]: r for r in context.collect()}
    lists = {r["event_id"]: r["previous_urls"] for r in S.latest_urls(context, depth).collect()}
    asked = spark.createDataFrame([(i,) for i in range(0, 400, 9)], "event_id long")
    histories = {}
    for r in sorted(S.previous_urls(context, asked).collect(), key=lambda r: r["position"]):
        histories.setdefault(r["event_id"], []).append(r["url"])
    assert len(got) == len(events) == len(lists)
    for session in (1, 2, 3):
        past = []
        for e in sorted((e for e in events if e[1] == session), key=lambda e: (e[2], e[0])):
            row = got[e[0]]
            assert row["position"] == len(past) and lists[e[0]] == [p[3] for p in past][-depth:]
            assert histories.get(e[0], []) == ([p[3] for p in past] if e[0] % 9 == 0 else [])
            assert row["sensitive_interaction_count"] == sum(bool(p[4]) for p in past)
            assert row["unique_domains_visited"] == len({urlparse(p[3]).hostname for p in past})
            past.append(e)


@pytest.mark.parametrize("parts, span", [(1, 6), (12, 6), (12, 0)])
def test_every_event_has_its_whole_history(spark, parts, span):
    """Also events of sessions over many parts, without a session or without a URL."""
    rng = random.Random(9)
    events = [
        (i, rng.choice([1, 1, 1, 1, 2, None]), moment(rng, span), rng.choice([f"https://h.com/{i}", f"https://h.com/{i}", None])) for i in range(300)
    ]
    rows = spark.createDataFrame(events, "event_id long, session_id long, timestamp timestamp, url string")
    found = S.whole_histories(rows, parts)
    got = {r["event_id"]: r["previous_urls"] for r in found.collect()}
    assert found.columns == [*rows.columns, "previous_urls"] and found.count() == len(events)
    for session in (1, 2, None):
        past = []
        for e in sorted((e for e in events if e[1] == session), key=lambda e: (e[2], e[0])):
            assert got[e[0]] == [url for url in past if url]
            past.append(e[3])


def test_query_gives_every_event_its_previous_urls(spark):
    """Not the newest event of each session alone."""
    from tidegate.plans import queries

    made = queries.QUERIES["w1_previous_urls"](spark, "/root/testdata/sf0.001")
    every = queries.guard_events(spark, "/root/testdata/sf0.001")
    assert made.columns == ["event_id", "session_id", "previous_urls"] and made.count() == every.count()
    assert made.join(every, "event_id", "left_anti").count() == 0


def test_parts_of_a_hot_session_are_even(spark):
    """A session with nine tenths of the rows, all at one time, is spread over the parts."""
    from tidegate.operators import scan

    rows = spark.range(20_000).selectExpr("id AS event_id", "IF(id % 10 = 0, id, 1) AS session_id", "timestamp'2024-01-01' AS timestamp")
    sizes = [r["count"] for r in scan.in_parts(rows, ["session_id"], ["timestamp", "event_id"], 10).groupBy(scan.PART).count().collect()]
    assert len(sizes) >= 9 and max(sizes) < 2 * 20_000 / 10


SESSIONS = "session_id long, user_id long, start_time timestamp, end_time timestamp, environment string, agent_name string"


@pytest.fixture(scope="module")
def sessions(spark):
    later = START + timedelta(days=1)
    return spark.createDataFrame(
        [(1, 5, START, None, "prod", "a"), (2, None, START, later, "test", "b"), (3, 6, START, None, "prod", "a")], SESSIONS
    )


def test_latest_open(sessions):
    assert [tuple(r) for r in S.latest_open_sessions(sessions).collect()] == [("a", "prod", 3)]


def test_attribution_errors(spark, sessions):
    later = START + timedelta(days=2)
    asked = [
        (1, START, "prod", "a", None), (2, START, "prod", "nobody", None), (3, START, None, None, 1), (4, START, "prod", "a", 9),
        (5, later, "test", "b", 2), (6, START, "test", "a", 1), (7, START, "prod", "z", 1), (8, START, "test", "b", 2),
    ]
    rows = spark.createDataFrame(asked, "event_id long, ts timestamp, environment string, agent_name string, session_id long")
    got = {r["event_id"]: r for r in S.attribute_sessions(rows, sessions).collect()}
    assert (got[1]["session_id"], got[1]["error"]) == (3, None)
    assert got[2]["error"] == S.NO_SESSION
    assert (got[3]["environment"], got[3]["agent_name"], got[3]["error"]) == ("prod", "a", None)
    assert got[4]["error"] == "Provided session_id does not reference an existing session"
    assert got[5]["error"] == "Provided session_id is already closed"
    assert got[6]["error"] == "Provided environment does not match the referenced session"
    assert got[7]["error"] == "Provided agent_name does not match the referenced session"
    assert got[8]["error"] is None


def test_close_and_overwrite(spark, sessions):
    t1, t2 = START + timedelta(hours=1), START + timedelta(hours=2)
    asked = spark.createDataFrame([(1, 1, t2), (2, 1, t1), (3, 2, t1), (4, 9, t1)], "request_id long, session_id long, end_time timestamp")
    snapshot, outcomes = S.close_sessions(sessions, asked)
    ends = {r["session_id"]: r["end_time"] for r in snapshot.collect()}
    assert ends == {1: t1, 2: START + timedelta(days=1), 3: None}
    assert {r["request_id"]: r["outcome"] for r in outcomes.collect()} == {
        1: "already_closed", 2: "closed", 3: "already_closed", 4: "not_found",
    }
    ends = {r["session_id"]: r["end_time"] for r in S.overwrite_session_end(sessions, asked).collect()}
    assert ends == {1: t1, 2: t1, 3: None}


def test_cascading_delete(spark, sessions):
    events = spark.createDataFrame([(10, 1), (11, 2)], "event_id long, session_id long")
    lines = spark.createDataFrame([(100, 10), (101, 11)], "analysis_id long, event_id long")
    kept = S.delete_sessions(sessions, events, lines, sessions.filter("session_id = 1"))
    assert [sorted(r[0] for r in k.collect()) for k in (kept[0], kept[1].select("event_id"), kept[2].select("analysis_id"))] == [
        [2, 3], [11], [101],
    ]
    users = spark.createDataFrame([(5, "u5", False), (6, "u6", False)], "user_id long, username string, is_admin boolean")
    left, changed = S.delete_users(users, sessions, users.filter("user_id = 5"))
    assert [r["user_id"] for r in left.collect()] == [6]
    assert {r["session_id"]: r["user_id"] for r in changed.collect()} == {1: None, 2: None, 3: 6}


def test_stats(spark, sessions):
    events = spark.createDataFrame(
        [(1, 1, "Allow", 0.25), (2, 1, "Warn", 0.8)], "event_id long, session_id long, guard_action string, risk_score double"
    )
    got = {r["session_id"]: tuple(r)[1:] for r in A.session_stats(sessions, events).collect()}
    assert got[1] == (2, 1, 1, 0, pytest.approx(0.525)) and got[2] == (0, 0, 0, 0, 0.0)
    assert {r["session_id"]: r["average_risk_score"] for r in A.sessions_with_risk(sessions, events).collect()}[3] == 0.0


def test_rule_changes(spark):
    rules = K.registry_rules(spark)
    changes = spark.createDataFrame([("typosquatting", False), ("nope", True)], "rule_code string, is_enabled boolean")
    snapshot, unknown = K.set_rules_enabled(rules, changes)
    assert snapshot.filter("not is_enabled").select("rule_code").collect()[0][0] == "typosquatting"
    assert [r[0] for r in unknown.collect()] == ["nope"]
    with pytest.raises(ValueError):
        K.set_rules_enabled(rules, changes.withColumn("is_enabled", F.lit("yes")))
    assert K.register_missing_rules(rules, rules).count() == 9


def test_listing_arguments(spark):
    rules = K.registry_rules(spark)
    lines = spark.createDataFrame([(i, i, "typosquatting", 1.0, "d") for i in range(5)], "analysis_id long, event_id long, rule_code string, rule_score double, details string")
    got = [r["analysis_id"] for r in A.latest_analyses(lines, rules, " typosquatting ", 2).collect()]
    assert got == [4, 3]
    for code, limit in (("", 1), ("x" * 31, 1), ("typosquatting", 0), ("typosquatting", 1001)):
        with pytest.raises(ValueError):
            A.latest_analyses(lines, rules, code, limit)
