"""Matching jobs against brute force on small fixtures."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from tidegate.operators import filters as T
from tidegate.operators import matching as M
from tidegate.sources import dims, readers


def column(df, name):
    return sorted(r[name] for r in df.collect())


def test_blocklist_lines(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("\n# full line comment\n  Bad.EXAMPLE.com\n\n  https://X.Y/z  # tail comment\nbad.example.com\n", encoding="utf-8")
    assert column(readers.read_blocklist(spark, str(path)), "entry") == ["bad.example.com", "https://x.y/z"]
    assert readers.read_blocklist(spark, str(tmp_path / "nope.txt")).count() == 0


def test_filter_list_lines(spark, tmp_path):
    path = tmp_path / "easy.txt"
    path.write_text("||ads.com^$third-party\n! c\n||no-caret\n@@||x.com^\n||a||b.com^y^\n", encoding="utf-8")
    assert column(readers.read_filter_list(spark, str(path)), "domain") == ["ab.com", "ads.com"]


@pytest.mark.parametrize(
    "entry, url, hit",
    [
        ("youtube.com", "https://www.youtube.com/watch?v=123", True),
        ("www.youtube.com", "https://m.youtube.com/", True),
        (".youtube.com.", "https://youtube.com/", True),
        ("tube.com", "https://youtube.com/", False),
        ("https://example.com/login", "https://example.com/login?next=%2Fhome", True),
        ("https://example.com/login/", "https://example.com/login/?next=%2Fhome", True),
        ("https://example.com/login", "https://example.com/login/deeper", False),
        ("https://example.com/login?next=%2fhome", "https://example.com/login?next=%2Fdashboard", False),
        ("https://example.com/login?next=%2fhome", "https://example.com/LOGIN?next=%2Fhome", True),
        ("https://example.com", "http://sub.example.com/any", True),
        ("https://example.com/?a=1", "https://example.com/?a=1", True),
        ("https://example.com/?a=1", "https://example.com/", False),
        ("example.com/x", "https://example.com/x", False),
        ("localhost", "http://localhost/", True),
    ],
)
def test_blocklist_entry(spark, entry, url, hit):
    rows = spark.createDataFrame([(url,)], "url string")
    entries = spark.createDataFrame([(entry,)], "entry string")
    assert M.with_blocklist(rows, entries).collect()[0]["blocklisted"] is hit


def test_filter_list_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["ad", "track", "stat", "x", "cdn", "metrics", "shop", "news", "a"]
    hosts = {".".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(300)} | {""}
    listed = {".".join(rng.choice(words) for _ in range(rng.randint(1, 2))) for _ in range(25)} | {"x", "ad", ""}
    listed -= {"a"}
    got = M.filter_list_hits(
        spark.createDataFrame([(h,) for h in hosts], "host string"),
        spark.createDataFrame([(d.upper() if len(d) > 5 else d,) for d in listed], "domain string"),
    )
    assert column(got, "host") == sorted(h for h in hosts if any(d and d in h for d in listed))


@pytest.mark.parametrize("parts", [1, 9])
def test_verdict_lifetime(spark, parts):
    rng, start = random.Random(5), datetime(2024, 1, 1)
    seen = [(rng.choice("abc"), start + timedelta(seconds=i * 37), rng.random() < 0.5, "URLhaus") for i in range(0, 900, 3)]
    asked = [(i, rng.choice("abcd"), start + timedelta(seconds=rng.randint(0, 40_000))) for i in range(400)]
    got = M.verdicts_as_of(
        spark.createDataFrame(asked, "request_id long, domain string, timestamp timestamp"),
        spark.createDataFrame(seen, "domain string, observed_at timestamp, listed boolean, source string"),
        parts=parts,
    )
    want = {}
    for key, domain, at in asked:
        past = [(s[1], s[2]) for s in seen if s[0] == domain and s[1] <= at]
        best = max(past, default=None)
        want[key] = best[1] if best and (at - best[0]).total_seconds() < 3600 else None
    assert {r["request_id"]: r["listed"] for r in got.collect()} == want


def test_forwarding(spark):
    def forward(url, ua="Mozilla/5.0 Chrome/120.0.0.0", blocked=False, listed=False, method="GET", **headers):
        pairs = {"user-agent": ua, **headers}
        rows = spark.createDataFrame([(url, method, pairs)], "url string, method string, h map<string,string>")
        return rows.select(
            T.should_forward(F.col("url"), F.col("method"), F.col("h"), F.lit(listed), F.lit(blocked))
        ).collect()[0][0]

    assert forward("https://www.example.org/")
    assert not forward("https://www.example.org/", ua="curl/8.0.1")
    assert not forward("https://www.example.org/", method="OPTIONS")
    assert not forward("https://www.example.org/", listed=True)
    assert forward("https://www.example.org/", listed=True, blocked=True)
    assert not forward("https://telemetry.example.org/")
    assert not forward("https://www.example.org/", upgrade="WebSocket")
    assert not forward("https://www.example.org/check-update")
    assert not forward("https://www.example.org/", nel="x")


def test_response_needs_a_body_and_success(spark):
    def ignored(status, body, method="GET", ctype="text/html", url="https://e.org/p"):
        rows = spark.createDataFrame(
            [(url, method, {"user-agent": "Chrome/1"}, status, {"content-type": ctype}, body)],
            "url string, method string, h map<string,string>, status int, rh map<string,string>, body string",
        )
        return rows.select(
            T.should_ignore_response(
                F.col("url"), F.col("method"), F.col("h"), F.col("status"), F.col("rh"), F.col("body"), F.lit(False)
            )
        ).collect()[0][0]

    assert not ignored(200, "x")
    assert ignored(200, "") and ignored(404, "x") and ignored(None, "x")
    assert ignored(200, "x", ctype="Image/png") and ignored(200, "x", url="https://e.org/a.CSS?x=1")
    assert ignored(200, "x", method="HEAD")


def test_event_filter_arguments(spark):
    rows = spark.createDataFrame(
        [(1, 7, "Allow", 0.25, datetime(2024, 1, 1)), (2, 7, "Warn", 0.8, datetime(2024, 1, 2))],
        "event_id long, session_id long, guard_action string, risk_score double, timestamp timestamp",
    )
    assert column(T.filter_events(rows, guard_action="Warn"), "event_id") == [2]
    assert column(T.filter_events(rows, min_risk=0.25, max_risk=0.25), "event_id") == [1]
    assert column(T.filter_events(rows, session_id=7, from_ts="2024-01-01T00:00:00Z", to_ts="2024-01-01T00:00:00Z"), "event_id") == [1]
    for bad in (
        {"guard_action": "allow"}, {"min_risk": 2}, {"min_risk": "x"}, {"min_risk": 0.9, "max_risk": 0.1},
        {"from_ts": "soon"}, {"from_ts": "2024-01-02", "to_ts": "2024-01-01"}, {"max_risk": float("nan")},
    ):
        with pytest.raises(ValueError):
            T.filter_events(rows, **bad)


def test_event_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr(
        "id AS event_id", "id AS session_id", "'Warn' AS guard_action", "id / 10.0D AS risk_score", "current_timestamp() AS timestamp"
    ).write.parquet(str(tmp_path / "e"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = T.filter_events(spark.read.parquet(str(tmp_path / "e")), session_id=3, min_risk=0.1)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(session_id,3)" in text and "GreaterThanOrEqual(risk_score,0.1)" in text


def test_hosts_as_the_standard_library_sees_them(spark):
    urls = ["https://A.com/x", "https://b.com:1/y", "https://u@c.com?z", "no"]
    got = M.distinct_hosts(spark.createDataFrame([(u,) for u in urls], "url string"))
    assert column(got, "host") == sorted({urlparse(u).hostname or "" for u in urls})


def test_typosquats_by_join_equal_the_search(spark):
    rng = random.Random(9)
    names = [label for *_, label in dims.brand_rows()]
    hosts = set()
    for _ in range(400):
        word = list(rng.choice(names))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word))
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "1", "rn", "0", "l", "e"])
            word = word or ["a"]
        hosts.add(rng.choice(["", "www.", "login."]) + "".join(word) + rng.choice([".com", ".io", ".co.uk"]))
    hosts |= {"192.168.1.1", "", "localhost", "icloud.com"}
    rows = spark.createDataFrame([(h,) for h in sorted(hosts)], "host string")
    hit = M.typosquat_hit(F.col("host"), F.col("own"), F.col("plain"))
    searched = M.with_labels(rows).select("host", hit.alias("h")).filter("h is not null").select("host", "h.*")
    joined = M.typosquat_hits(rows, dims.brand_domains(spark))
    want = sorted(map(tuple, searched.collect()))
    assert want and sorted(map(tuple, joined.collect())) == want


def test_brand_names_are_taken_as_they_are(spark):
    """Names are no patterns, and an empty brand table has no hits."""
    from pyspark.sql import functions as F

    from tidegate.operators import matching as M

    page = spark.createDataFrame([("shop(x is here", "a.org")], "title string, host string")
    rows = [("shop(x", 1, "shopx.com", 1, "shopx")]
    assert page.select(M.brand_mismatch(F.col("title"), F.col("host"), rows)).first()[0] == "shop(x"
    assert page.select(M.brand_mismatch(F.col("title"), F.col("host"), [])).first()[0] is None
