from __future__ import annotations

import random
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from tidegate.functions import text as X
from tidegate.functions import urls as U
from tidegate.operators import pages as P
from tidegate.sources import dims

PAGE = (
    "<html><head><title> Pay&amp;Pal <b>x</b></title><meta name=A content=1><meta http-equiv='a' content=\"2\">"
    "<script src=\"/s.js\">var a='<input type=password>';</script></head><body>a<!-- <input> -->b<p title=it's>t1 &copy; x</p>"
    "<form action=\"https://evil.com/x\" METHOD=POST><input type=\"password\" name=pw><form><input id='q>r' NAME=\"n1\"></form>"
    "<input name=n2></form></form><input TYPE=Text><a href>l</a><a href='../z?x=1&amp;y=2'>m</a><form/><input name=n4></body>"
)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(0, "https://h.com/a/b", PAGE), (1, "https://h.com/", ""), (2, "https://h.com/", "<title>un"),
            (3, "https://h.com/", "<p " + "a=1 " * 20_000 + ">x</p>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def of_page(df, page=0):
    return [tuple(r)[1:] for r in df.filter(F.col("page_id") == page).collect()]


def test_titles(pages):
    assert of_page(P.page_titles(pages)) == [("Pay&Palx",)]
    assert of_page(P.page_titles(pages), 1) == [("",)]
    assert of_page(P.page_titles(pages), 2) == [("un",)]


def test_text_keeps_comment_borders(pages):
    assert of_page(P.page_text(pages)) == [("Pay&Pal x a b t1 © x l m",)]


def test_forms(pages):
    assert of_page(P.page_forms(pages)) == [
        (1, "https://evil.com/x", "post", "evil.com"), (2, "", "get", "h.com"), (3, "", "get", "h.com"),
    ]


def test_inputs_lie_in_every_enclosing_form(pages):
    assert of_page(P.page_inputs(pages)) == [
        (1, 1, "password", "pw", ""), (1, 2, "text", "n1", "q>r"), (2, 2, "text", "n1", "q>r"),
        (1, 3, "text", "n2", ""), (None, 4, "text", "", ""), (None, 5, "text", "n4", ""),
    ]


def test_closing_an_ancestor_closes_the_form(spark):
    html = (
        "<div><form action=/a><p><br><input name=1></div><input name=2></form>"
        "<table><form><tr></form></tr><input name=3></table><b><i><form></b></i><input name=4></span><div/><form><div></p><input name=5>"
    )
    rows = spark.createDataFrame([(0, "https://h.com/", html)], "page_id long, url string, html string")
    assert [(r[0], r[3]) for r in of_page(P.page_inputs(rows))] == [(1, "1"), (None, "2"), (None, "3"), (None, "4"), (4, "5")]


def test_links_scripts_meta(pages):
    assert of_page(P.page_links(pages)) == [(1, "https://h.com/a/b"), (2, "https://h.com/z?x=1&y=2")]
    assert of_page(P.page_scripts(pages)) == [(1, "https://h.com/s.js")]
    assert of_page(P.page_meta(pages)) == [("a", "2")]


def test_tag_with_many_attributes(pages):
    assert [t[1] for t in of_page(P.page_tags(pages), 3)] == ["p", "p"]


def test_features(spark, pages):
    rows = pages.select(
        F.col("page_id").alias("request_id"), "url", F.col("html").alias("body"),
        F.create_map(F.lit("Content-Type"), F.lit("Text/HTML")).alias("req_headers"),
    )
    found = {r["request_id"]: r for r in P.page_features(rows).collect()}
    dom = found[0]["dom"]
    assert found[0]["headers"] == {"content-type": "Text/HTML"}
    assert [len(f["inputs"]) for f in dom["forms"]] == [3, 1, 0, 2]
    assert dom["forms"][-1]["action_host"] == "" and dom["meta_tags"] == {"a": "2"}
    assert found[1]["dom"] is None and found[1]["is_html"]


def test_binary_body_is_decoded(spark):
    rows = spark.createDataFrame(
        [(1, {"content-type": "text/html"}, bytearray(b"<p>\xff\xc3\xa9</p>"))],
        "request_id long, req_headers map<string,string>, body binary",
    )
    assert P.html_pages(rows).collect()[0]["raw_body"] == "<p>�é</p>"


BASES = ["https://a.com/b/c", "http://h.com", "https://a.com/b/c/", "https://u:p@A.com:80/x;y?q=1#f", "https://[::1]:8080/a"]
REFS = [
    "", "/x", "x", "../x", "../../../x", "./", "..", "?a=b", "#f", "//o.com/z", "http://q.com", "https:foo", "mailto:x@y",
    "javascript:void(0)", "a//b", "a/./b/../c/", "/a/../b?x#y", "x?y=/../z", "HTTPS://B.com/Q", "/a//b", "/a?", "/.hidden/x", "/ü/ñ?q=ä",
]


def test_join_url_agrees_with_the_standard_library(spark):
    rows = spark.createDataFrame([(b, r) for b in BASES for r in REFS], "b string, r string")
    found = rows.select(
        "b", "r", U.join_url(F.col("b"), F.col("r")).alias("j"), U.joined_host(F.col("b"), F.col("r")).alias("h")
    ).collect()
    for row in found:
        want = urljoin(row["b"], row["r"])
        assert (row["j"], row["h"]) == (want, urlparse(want).hostname or ""), row


def test_host_parts(spark):
    urls = ["https://User@WWW.Ex.com:8080/p;x?q#f", "http://[::1]:80/", "//h.com/x", "nothing", "https://пример.рф/x", "http://a_b.com/"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    for row in rows.select("u", U.host(F.col("u")).alias("h"), U.scheme(F.col("u")).alias("s"), U.query(F.col("u")).alias("q")).collect():
        parsed = urlparse(row["u"])
        assert (row["h"], row["s"], row["q"]) == (parsed.hostname or "", parsed.scheme, parsed.query)


def test_labels(spark):
    want = {
        "login.paypal.com": "paypal", "evil.paypal.co.uk": "paypal", "a.b.github.io": "b", "github.io": "github",
        "localhost": "localhost", "com": "com", "x.unknown": "x", "": "", "paypa1.co.ke": "paypa1", "a.paypa1.pages.dev": "paypa1",
    }
    rows = spark.createDataFrame([(h,) for h in want], "h string")
    assert {r["h"]: r["l"] for r in rows.select("h", U.sld_label(F.col("h")).alias("l")).collect()} == want
    listed = ["com", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp"]
    odd = {"a.b.ck": "a", "x.www.ck": "www", "x.city.kawasaki.jp": "city", "a.b.kawasaki.jp": "a", "kawasaki.jp": "kawasaki"}
    rows = spark.createDataFrame([(h,) for h in odd], "h string")
    assert {r["h"]: r["l"] for r in rows.select("h", U.sld_label(F.col("h"), listed).alias("l")).collect()} == odd
    domains = spark.createDataFrame([(d, label) for _, _, d, _, label in dims.brand_rows()], "d string, label string")
    assert domains.filter(U.sld_label(F.col("d")) != F.col("label")).count() == 0


def test_suffix_list_files(spark, tmp_path, monkeypatch):
    """Expression and driver-side twin agree on any list; a file has a version; a missing one is told."""
    path = tmp_path / "list.dat"
    path.write_text("// VERSION: 7\n// a comment\ncom\nck trailing words\n*.ck\n!www.ck\n公司.cn\ncn\n", encoding="utf-8")
    listed = dims.suffix_list(str(path))
    assert listed.version == "7" and "xn--55qx5d.cn" in listed.entries and "ck" in listed.entries
    rng = random.Random(1)
    names = {".".join(rng.choice(["a", "b", "www", "ck", "com", "cn", "公司", "xn--55qx5d"]) for _ in range(rng.randint(1, 5))) for _ in range(400)}
    rows = spark.createDataFrame([(n,) for n in names], "h string")
    assert {r["h"]: r["l"] for r in rows.select("h", U.sld_label(F.col("h"), listed).alias("l")).collect()} == {n: dims.label_of(n, listed) for n in names}
    monkeypatch.setattr(dims.os.path, "isfile", lambda _: False)
    with pytest.warns(UserWarning, match="suffix list"):
        assert dims.suffix_list.__wrapped__().version == "common"


def test_brand_table_size():
    rows = dims.brand_rows()
    assert (len(rows), len({r[2] for r in rows}), len({r[4] for r in rows})) == (239, 237, 199)


def test_is_ip_agrees_with_the_standard_library(spark):
    import ipaddress

    names = ["1.2.3.4", "01.2.3.4", "1.2.3", "256.1.1.1", "::", "::1", "1::", "a:b:c:d:e:f:1:2", "1:2:3:4:5:6:7::", "::ffff:1.2.3.4",
             "1:2:3:4:5:6:1.2.3.4", ":::", "1::2::3", "fe80::1%eth0", "g::1", "1:2:3:4:5:6:7:8:9", "example.com", ""]

    def is_ip(name):
        try:
            ipaddress.ip_address(name)
            return True
        except ValueError:
            return False

    rows = spark.createDataFrame([(n,) for n in names], "n string")
    for row in rows.select("n", U.is_ip(F.col("n")).alias("ip")).collect():
        assert row["ip"] == is_ip(row["n"]), row


def test_entities(spark):
    want = {
        "a &amp; b": "a & b", "&copy 2020": "© 2020", "&foo;x": "&foox", "&#39;&#x27;&#8364;&#x1F600;": "''€😀",
        "&amp;lt;": "&lt;", "none": "none", "&eacute;t&eacute;": "été", "&": "&",
    }
    rows = spark.createDataFrame([(s,) for s in want], "s string")
    assert {r["s"]: r["d"] for r in rows.select("s", X.decode_entities(F.col("s")).alias("d")).collect()} == want


def test_times(spark):
    want = {
        "2024-01-01T00:00:00Z": "2024-01-01T00:00:00Z", "2024-01-01": "2024-01-01T00:00:00Z",
        "2024-01-01 10:00": "2024-01-01T10:00:00Z", "2024-01-01T10:00:00.999+0200": "2024-01-01T08:00:00Z",
        "bad": None, "2024": None, "2024-13-01T00:00:00Z": None, " 2024-01-01T10+02:00 ": "2024-01-01T08:00:00Z",
    }
    rows = spark.createDataFrame([(s,) for s in want], "s string")
    assert {r["s"]: r["t"] for r in rows.select("s", X.iso_z(X.parse_iso(F.col("s"))).alias("t")).collect()} == want


def test_agents_and_headers(spark):
    rows = spark.createDataFrame([("a!b  c",), ("   ",), ("é" * 30,), (None,)], "s string")
    assert [r[0] for r in rows.select(X.clean_agent(F.col("s"))).collect()] == ["ab  c", "browserOS", "é" * 20, "browserOS"]
    one = spark.sql("SELECT map('X-Agent-Name', 'me', 'x-agent-name', 'you', 'B', '2') AS m")
    row = one.select(
        X.lower_keys(F.col("m")).alias("low"), X.encode_headers(F.col("m")).alias("json"),
        X.agent_from_headers(F.col("m")).alias("agent"), X.header(F.col("m"), "b").alias("b"),
    ).collect()[0]
    assert row["low"] == {"x-agent-name": "you", "b": "2"} and row["b"] == "2" and row["agent"] == "you"
    assert row["json"] == '{"B":"2","X-Agent-Name":"me","x-agent-name":"you"}'
    bad = spark.createDataFrame([("{bad",)], "t string").select(X.decode_headers(F.col("t"))).collect()[0][0]
    assert not bad


def test_many_forms_and_inputs_in_one_page(spark):
    """The work follows the size of the page: seconds, not minutes."""
    import time

    forms = "".join(f'<form action="/a{i}"></form>' for i in range(3_000))
    inputs = "<form>" + '<input name="n">' * 6_000 + "</form>"
    pages = spark.createDataFrame([(1, "https://a.org/", forms), (2, "https://b.org/", inputs)], "page_id long, url string, html string")
    started = time.time()
    found = P.page_forms(pages.where("page_id = 1"))
    assert found.where("action = '/a' || (form_no - 1)").count() == 3_000
    assert P.page_inputs(pages.where("page_id = 2")).where("form_no = 1").count() == 6_000
    assert time.time() - started < 60


def test_pages_of_very_many_tags(spark):
    """Work follows the page: 30,000 meta names, some repeated, and 4,000 forms with their inputs."""
    import time

    metas = "".join(f"<meta name='N{i % 29_000}' content={i}>" for i in range(30_000))
    forms = "".join(f"<form action=/{i}><input name=a{i}><input name=b{i}></form>" for i in range(4_000))
    rows = spark.createDataFrame([(1, "https://a.com/", metas), (2, "https://a.com/", forms)], "page_id long, url string, html string")
    begun = time.time()
    found = {r["name"]: r["content"] for r in P.page_meta(rows).filter("page_id = 1").collect()}
    assert found == {f"n{i}": str(i if i >= 1_000 else i + 29_000) for i in range(29_000)}
    traffic = rows.select(F.col("page_id").alias("request_id"), "url", F.col("html").alias("body"), F.expr("map('Content-Type', 'text/html')").alias("req_headers"))
    dom = {r["request_id"]: r["dom"] for r in P.page_features(traffic).collect()}
    assert dom[1]["meta_tags"] == found
    assert [[i["name"] for i in f["inputs"]] for f in dom[2]["forms"]] == [[f"a{i}", f"b{i}"] for i in range(4_000)]
    assert time.time() - begun < 60


def test_headers_that_collide(spark):
    rows = spark.sql("SELECT map('A', '1', 'b', '2', 'a', '3') AS h UNION ALL SELECT map() UNION ALL SELECT NULL")
    assert [r[0] for r in rows.select(X.lower_keys(F.col("h"))).collect()] == [{"b": "2", "a": "3"}, {}, None]


def test_references_equal_the_standard(spark):
    """Attributes: whatever `html.unescape` makes of random references; page text: names and numbers of any kind."""
    import html
    import html.entities

    rng = random.Random(9)
    names = list(html.entities.html5)
    numbers = ["#0", "#x0", "#x0000041;", "#65", "#00065;", "#128;", "#x80;", "#x9F", "#x81;", "#xD800;", "#x110000;", "#99999999999;", "#x1F600;",
               "#13;", "#11;", "#xFFFE;", "#x7f;", "#xfdd0;", "#65a", "#xg", "#", "#;", "#x;"]
    texts = ["".join(rng.choice(["&", "&", "a", ";", " ", "x&", "é"]) + rng.choice([rng.choice(names), rng.choice(names)[:-1], rng.choice(numbers), "notit;", "zz", ""])
                     for _ in range(rng.randint(1, 6))) for _ in range(1500)]
    texts += [f"&{n}" for n in names] + [f"&{n}" for n in numbers] + ["", "&", "&&amp;", "&amp", "&ampx;", "&CounterClockwiseContourIntegral;" * 3]
    rows = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "s string")
    got = {r["s"]: r["a"] for r in rows.select("s", X.decode_entities(F.col("s"), attribute=True).alias("a")).collect()}
    assert {s: a for s, a in got.items() if a != html.unescape(s).replace("\ud800", "\ufffd")} == {}
    want = {
        "&#x0000041;b": "Ab", "&#x80;": "€", "&#150;": "–", "&#x81;": "\x81", "&#99999999999;": "\ufffd", "&hellip x": "… x", "&NotEqualTilde;": "≂̸",
        "&notit;": "&notit", "&copy-x": "&copy-x", "&#65a": "&#65a", "&#x1F600": "😀", "&#xD800;": "\ufffd", "&amp;&lt": "&<",
    }
    rows = spark.createDataFrame([(s,) for s in want], "s string")
    assert {r["s"]: r["d"] for r in rows.select("s", X.decode_entities(F.col("s")).alias("d")).collect()} == want
