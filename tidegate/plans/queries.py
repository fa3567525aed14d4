"""Registered queries: every job run over the whole given tables, with its oracle beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate import schemas
from tidegate.functions import text as X
from tidegate.functions import urls as U
from tidegate.operators import decisions as D
from tidegate.operators import enforcement as E
from tidegate.operators import filters as T
from tidegate.operators import intake as N
from tidegate.operators import matching as M
from tidegate.operators import pages as P
from tidegate.operators import quality as Q
from tidegate.operators import reports as A
from tidegate.operators import rules as R
from tidegate.operators import rulestore as K
from tidegate.operators import sessions as S
from tidegate.plans import oracle as O
from tidegate.plans import views as V
from tidegate.session import checkpoint, scratch_path
from tidegate.sources import dims, readers, writers
from tidegate.sources import publish as B
from tidegate.sources.publish import Change, TableSet
from tidegate.streaming import jobs as J

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def long(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("long")


def iso_us(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


# ------------------------------------------------------------------ inputs
def blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parse_blocklist(V.load(spark, sf_dir, "blocklist_lines"))


def filter_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parse_filter_list(V.load(spark, sf_dir, "filter_lines"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.load(spark, sf_dir, "threat_feed")


def html_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.load(spark, sf_dir, "traffic").select("request_id", "url", "html")


SOFT = {r.rule_id: r.rule_id in O.SOFT for r in dims.RULE_REGISTRY}


def scored(spark: SparkSession, sf_dir: str, enabled=None, keep=("request_id", "url", "method")) -> DataFrame:
    return R.evaluate(
        V.traffic(spark, sf_dir), feed(spark, sf_dir), blocklist(spark, sf_dir), enabled, keep=keep
    )


AUDITED = ("request_id", "url", "method", "timestamp", "environment", "agent_name", "session_id", "req_headers")


def guard_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.load(spark, sf_dir, "guard_events").withColumnRenamed("ts", "timestamp")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.load(spark, sf_dir, "sessions")


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.load(spark, sf_dir, "rules_analysis")


def rules(spark: SparkSession) -> DataFrame:
    return K.registry_rules(spark)


RULE_VALUES = "SELECT * FROM (VALUES " + ", ".join(
    f"({O.q(r.rule_id)}, CAST({r.weight} AS DOUBLE), 'deterministic', 'cheap', TRUE, {str(r.hard_block).upper()}, {O.q(r.description)})"
    for r in dims.RULE_REGISTRY
) + ") AS t(rule_code, weight, rule_type, compute_class, is_enabled, is_hard_block, description)"
RULES_X = {"rules": RULE_VALUES}


# ------------------------------------------------------------------ S sources and sinks
@query(
    "s1_traffic_source",
    O.with_ctes(
        f"""SELECT request_id, method, url, status_code::BIGINT AS status_code, environment, agent_name,
                   {O.iso_us('ts')} AS ts, user_agent, length(html) AS body_chars FROM pages_x""",
        "pages_x",
    ),
)
def s1(spark, sf_dir):
    return readers.finish_traffic(V.traffic(spark, sf_dir)).select(
        "request_id", "method", "url", long("status_code").alias("status_code"), "environment", "agent_name",
        iso_us("timestamp").alias("ts"), X.header(F.col("req_headers"), "user-agent").alias("user_agent"),
        long(F.length("body")).alias("body_chars"),
    )


@query("s2_blocklist_source", O.with_ctes("SELECT entry FROM blocklist", "blocklist"))
def s2(spark, sf_dir):
    path = scratch_path(spark, "blocklist")
    V.load(spark, sf_dir, "blocklist_lines").write.text(path)
    return readers.read_blocklist(spark, path)


@query("s3_filter_list_source", O.with_ctes("SELECT domain FROM filter_list", "filter_list"))
def s3(spark, sf_dir):
    path = scratch_path(spark, "filters")
    V.load(spark, sf_dir, "filter_lines").write.text(path)
    return readers.read_filter_list(spark, path)


@query(
    "s4_threat_feed_source",
    O.from_views(f"SELECT domain, source, listed, {O.iso_us('observed_at')} AS observed_at FROM threat_feed", "threat_feed"),
)
def s4(spark, sf_dir):
    path = scratch_path(spark, "feed")
    feed(spark, sf_dir).write.parquet(path)
    return readers.read_threat_feed(spark, path).withColumn("observed_at", iso_us("observed_at"))


@query(
    "s5_brand_dimension",
    O.with_ctes(
        """SELECT b.brand, b.brand_ord::BIGINT AS brand_ord, b.domain, b.domain_ord::BIGINT AS domain_ord, b.label, count(p.request_id) AS requests
           FROM brands b LEFT JOIN labels_x l ON l.plain = b.label LEFT JOIN pages_x p ON p.host = l.host GROUP BY ALL""",
        "labels_x",
    ),
)
def s5(spark, sf_dir):
    label = U.sld_label(U.normalize_confusables(U.strip_www(U.host(F.col("url")))))
    per_label = html_view(spark, sf_dir).groupBy(label.alias("label")).agg(F.count("*").alias("requests"))
    return (
        dims.brand_domains(spark).join(per_label, "label", "left").fillna({"requests": 0})
        .withColumns({"brand_ord": long("brand_ord"), "domain_ord": long("domain_ord")})
    )


@query(
    "s6_audit_tables",
    O.scoring(
        """SELECT s.request_id AS event_id, strftime(s.ts, '%Y-%m-%d') AS event_date, s.url,
                  upper(s.decision[1]) || s.decision[2:] AS guard_action, s.risk_score, upper(s.method) AS http_method,
                  count(l.request_id) AS analyses, round(sum(coalesce(l.score, 0)), 6) AS score_sum
           FROM scored s LEFT JOIN long l ON l.request_id = s.request_id GROUP BY ALL"""
    ),
)
def s6(spark, sf_dir):
    path = scratch_path(spark, "audit")
    writers.write_audit_tables(scored(spark, sf_dir, keep=AUDITED), path)
    events, lines = spark.read.parquet(f"{path}/events"), spark.read.parquet(f"{path}/rules_analysis")
    per_event = lines.groupBy("event_id").agg(
        F.count("*").alias("analyses"), F.round(F.sum(F.coalesce("rule_score", F.lit(0.0))), 6).alias("score_sum")
    )
    return events.join(per_event, "event_id", "left").select(
        "event_id", F.col("event_date").cast("string").alias("event_date"), "url", "guard_action", "risk_score",
        "http_method", "analyses", "score_sum",
    )


@query(
    "s7_audit_log",
    O.scoring(
        f"""SELECT '{{"agent":"' || agent_name || '","decision":"' || decision || '","environment":"' || environment
              || '","event_id":' || request_id || ',"hard_block_triggered":' || hard_block_triggered || ',"method":"' || upper(method)
              || '","risk_score":' || risk_score || ',"rule_count":' || rule_count || ',"session_id":null,"stage_b_required":' || coalesce(stage_b_required, false)
              || ',"timestamp":"' || {O.iso('ts')} || '","triggered_rule_count":' || triggered_rule_count || ',"url":"' || url || '"}}' AS value
            FROM scored"""
    ),
)
def s7(spark, sf_dir):
    path = scratch_path(spark, "log")
    writers.write_audit_log(writers.decision_records(scored(spark, sf_dir, keep=AUDITED)), path)
    return spark.read.text(path)


@query(
    "s8_header_codec",
    O.from_views(
        """SELECT event_id, headers_json, json_extract_string(headers_json, '$.k') AS k,
                  '{"k":"' || json_extract_string(headers_json, '$.k') || '"}' AS encoded FROM guard_events""",
        "guard_events",
    ),
)
def s8(spark, sf_dir):
    return readers.with_headers(guard_events(spark, sf_dir)).select(
        "event_id", "headers_json", F.col("headers")["k"].alias("k"), X.encode_headers(F.col("headers")).alias("encoded")
    )


# ------------------------------------------------------------------ F traffic filters
def _flag(name: str, flag: str, fn: Callable[[], Column], column: str | None = None) -> None:
    @query(name, O.with_ctes(f"SELECT request_id, url, {column or flag} AS {flag} FROM weblog_flags", "weblog_flags"))
    def run(spark, sf_dir):
        return V.weblog(spark, sf_dir).select("request_id", "url", fn().alias(flag))


_flag("f1_browser_ua", "browser", lambda: T.is_browser_ua(X.header(F.col("req_headers"), "user-agent")))
_flag("f2_enforced_method", "enforced", lambda: T.is_enforced_method(F.col("method")))
_flag("f3_static_resource", "static", lambda: T.is_static_resource(F.col("url")))
_flag("f4_sec_fetch", "sec_fetch", lambda: T.is_sec_fetch_subresource(F.col("req_headers")))
_flag("f5_binary_media", "media", lambda: T.is_binary_media(F.col("resp_headers")))
_flag("f6_upgrade", "upgrade", lambda: T.is_upgrade(F.col("req_headers")))
_flag("f7_noise_token", "noise_token", lambda: T.host_has_noise_token(U.host(F.col("url"))))


def flagged_weblog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.weblog(spark, sf_dir)
    thin = rows.select(
        "request_id", "method", "url", "status_code", "req_headers", "resp_headers",
        F.when(F.octet_length("resp_body") > 0, F.lit("x")).otherwise(F.lit("")).alias("resp_body"),
    )
    return M.with_blocklist(M.with_filter_list(thin, filter_list(spark, sf_dir)), blocklist(spark, sf_dir))


@query("f8_filter_list_host", O.with_ctes("SELECT request_id, url, host_listed FROM weblog_flags", "weblog_flags"))
def f8(spark, sf_dir):
    rows = V.weblog(spark, sf_dir).select("request_id", "url")
    return M.with_filter_list(rows, filter_list(spark, sf_dir))


@query("f9_noise", O.with_ctes("SELECT request_id, url, noise FROM weblog_verdicts", "weblog_verdicts"))
def f9(spark, sf_dir):
    noise = T.is_noise(F.col("url"), F.col("req_headers"), F.col("host_listed"))
    rows = V.weblog(spark, sf_dir).select("request_id", "url", "req_headers")
    return M.with_filter_list(rows, filter_list(spark, sf_dir)).select("request_id", "url", noise.alias("noise"))


@query("f10_should_forward", O.with_ctes("SELECT request_id, url, method FROM weblog_verdicts WHERE forward", "weblog_verdicts"))
def f10(spark, sf_dir):
    forward = T.should_forward(
        F.col("url"), F.col("method"), F.col("req_headers"), F.col("host_listed"), F.col("blocklisted")
    )
    return flagged_weblog(spark, sf_dir).filter(forward).select("request_id", "url", "method")


@query("f11_ignored_response", O.with_ctes("SELECT request_id, url, ignored FROM weblog_verdicts", "weblog_verdicts"))
def f11(spark, sf_dir):
    ignored = T.should_ignore_response(
        F.col("url"), F.col("method"), F.col("req_headers"), F.col("status_code"), F.col("resp_headers"),
        F.col("resp_body"), F.col("host_listed"),
    )
    return flagged_weblog(spark, sf_dir).select("request_id", "url", ignored.alias("ignored"))


@query(
    "f12_should_log",
    O.with_ctes(
        """SELECT request_id, NOT (static OR sec_fetch) AS log_request, NOT (static OR sec_fetch OR media) AS log_response
           FROM weblog_flags""",
        "weblog_flags",
    ),
)
def f12(spark, sf_dir):
    return V.weblog(spark, sf_dir).select(
        "request_id",
        T.should_log_request(F.col("url"), F.col("req_headers")).alias("log_request"),
        T.should_log_response(
            F.col("url"), F.col("req_headers"), F.col("status_code"), F.col("resp_headers")
        ).alias("log_response"),
    )


@query(
    "f13_event_filter",
    O.from_views(
        f"""SELECT event_id, session_id, {O.iso_us('ts')} AS ts, risk_score, guard_action FROM guard_events
            WHERE guard_action = 'Warn' AND risk_score >= 0.45 AND risk_score <= 0.65
              AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'""",
        "guard_events",
    ),
)
def f13(spark, sf_dir):
    found = T.filter_events(
        guard_events(spark, sf_dir), guard_action="Warn", min_risk=0.45, max_risk=0.65,
        from_ts="2024-01-05T00:00:00Z", to_ts="2024-01-20T12:00:00Z",
    )
    return found.select("event_id", "session_id", iso_us("timestamp").alias("ts"), "risk_score", "guard_action")


@query(
    "f14_session_search",
    O.from_views(
        """SELECT session_id, user_id, agent_name FROM sessions
           WHERE contains(lower(agent_name), '1') OR contains(session_id::VARCHAR, '1') OR coalesce(contains(user_id::VARCHAR, '1'), false)""",
        "sessions",
    ),
)
def f14(spark, sf_dir):
    return T.search_sessions(sessions(spark, sf_dir), " 1 ").select("session_id", "user_id", "agent_name")


@query(
    "f15_rule_search",
    O.from_views(
        """SELECT r.rule_code, r.is_hard_block, count(a.analysis_id) AS analyses
           FROM rules r LEFT JOIN rules_analysis a ON a.rule_code = r.rule_code
           WHERE (contains(lower(r.rule_code), 'domain') OR contains(lower(r.description), 'domain')) AND r.is_hard_block GROUP BY ALL""",
        "rules_analysis",
        extra=RULES_X,
    ),
)
def f15(spark, sf_dir):
    counts = analyses(spark, sf_dir).groupBy("rule_code").agg(F.count("*").alias("analyses"))
    found = T.search_rules(rules(spark), "Domain", rule_type="deterministic", hard_block=True)
    return found.join(counts, "rule_code", "left").fillna({"analyses": 0}).select("rule_code", "is_hard_block", "analyses")


# ------------------------------------------------------------------ P pages
@query(
    "p1_html_pages",
    O.with_ctes(
        "SELECT request_id, is_html, CASE WHEN is_html THEN md5(html) END AS body_md5 FROM pages_x", "pages_x"
    ),
)
def p1(spark, sf_dir):
    return P.html_pages(V.traffic(spark, sf_dir)).select(
        "request_id", "is_html", F.md5(F.col("raw_body").cast("binary")).alias("body_md5")
    )


@query(
    "p2_page_tags", O.with_ctes("SELECT request_id, pos::BIGINT AS pos, tag, closing, raw FROM tag_names", "tag_names")
)
def p2(spark, sf_dir):
    return P.page_tags(html_view(spark, sf_dir), "request_id").withColumn("pos", long("pos"))


@query("p3_page_titles", O.with_ctes("SELECT request_id, title FROM titles", "titles"))
def p3(spark, sf_dir):
    return P.page_titles(html_view(spark, sf_dir), "request_id")


@query("p4_page_text", O.with_ctes("SELECT request_id, text FROM texts", "texts"))
def p4(spark, sf_dir):
    return P.page_text(html_view(spark, sf_dir), "request_id")


@query("p5_page_forms", O.with_ctes("SELECT request_id, form_no, action, method, action_host FROM forms", "forms"))
def p5(spark, sf_dir):
    return P.page_forms(html_view(spark, sf_dir), "request_id").withColumn("form_no", long("form_no"))


@query("p6_page_inputs", O.with_ctes("SELECT request_id, form_no, input_no, type, name, id FROM inputs", "inputs"))
def p6(spark, sf_dir):
    return P.page_inputs(html_view(spark, sf_dir), "request_id").withColumns(
        {"form_no": long("form_no"), "input_no": long("input_no")}
    )


@query("p7_page_links", O.with_ctes("SELECT request_id, link_no, link FROM links", "links"))
def p7(spark, sf_dir):
    return P.page_links(html_view(spark, sf_dir), "request_id").withColumn("link_no", long("link_no"))


@query(
    "p7_page_scripts",
    O.with_ctes(
        """SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS script_no,
                  regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', 0) || '/assets/' || request_id || '.js' AS script
           FROM tag_names WHERE tag = 'script' AND NOT closing""",
        "scripts",
    ),
)
def p7_scripts(spark, sf_dir):
    tagged = F.replace(
        F.col("html"), F.lit("<script>"), F.concat(F.lit("<script src='/assets/"), F.col("request_id").cast("string"), F.lit(".js'>"))
    )
    return P.page_scripts(html_view(spark, sf_dir).withColumn("html", tagged), "request_id").withColumn(
        "script_no", long("script_no")
    )


@query("p8_page_meta", O.with_ctes("SELECT request_id, name, content FROM meta", "meta"))
def p8(spark, sf_dir):
    return P.page_meta(html_view(spark, sf_dir), "request_id")


@query(
    "p9_page_features",
    O.with_ctes(
        """SELECT p.request_id, p.host, p.scheme, p.is_html,
                  CASE WHEN p.is_html THEN t.title END AS title,
                  CASE WHEN p.is_html THEN length(x.text) END AS text_chars,
                  CASE WHEN p.is_html THEN (SELECT count(*) FROM forms f WHERE f.request_id = p.request_id)
                    + (SELECT count(*) FROM (SELECT DISTINCT request_id FROM inputs WHERE form_no IS NULL) o WHERE o.request_id = p.request_id) END AS forms,
                  CASE WHEN p.is_html THEN (SELECT count(*) FROM inputs i WHERE i.request_id = p.request_id) END AS inputs,
                  CASE WHEN p.is_html THEN (SELECT count(*) FROM links l WHERE l.request_id = p.request_id) END AS links,
                  CASE WHEN p.is_html THEN (SELECT count(*) FROM meta m WHERE m.request_id = p.request_id) END AS metas
           FROM pages_x p JOIN titles t USING (request_id) JOIN texts x USING (request_id)""",
        "meta",
    ),
)
def p9(spark, sf_dir):
    size = lambda c: F.when(F.col("dom").isNotNull(), F.size(c).cast("long"))
    return P.page_features(V.traffic(spark, sf_dir)).select(
        "request_id", "host", "scheme", "is_html",
        F.col("dom.page_title").alias("title"),
        long(F.length("dom.all_text_content")).alias("text_chars"),
        size("dom.forms").alias("forms"),
        size(F.flatten(F.transform("dom.forms", lambda f: f["inputs"]))).alias("inputs"),
        size("dom.links").alias("links"),
        size("dom.meta_tags").alias("metas"),
    )


# ------------------------------------------------------------------ J joins
@query("j1_threat_feed_join", O.with_ctes("SELECT host, candidate, source FROM feed_hits", "feed_hits"))
def j1(spark, sf_dir):
    hosts = M.distinct_hosts(html_view(spark, sf_dir))
    return M.feed_hits(hosts, feed(spark, sf_dir)).select("host", "feed_hit.candidate", "feed_hit.source")


@query(
    "j2_filter_list_join",
    O.with_ctes("SELECT DISTINCT host FROM weblog_flags WHERE host_listed", "weblog_flags"),
)
def j2(spark, sf_dir):
    return M.filter_list_hits(M.distinct_hosts(V.weblog(spark, sf_dir)), filter_list(spark, sf_dir))


@query("j3_blocklist_join", O.with_ctes("SELECT request_id, blocklisted FROM blocked", "blocked"))
def j3(spark, sf_dir):
    rows = html_view(spark, sf_dir).select("request_id", "url")
    return M.with_blocklist(rows, blocklist(spark, sf_dir)).select("request_id", "blocklisted")


@query(
    "j3_blocklist_rules",
    O.with_ctes("SELECT entry, kind, rule_host, url_base, query FROM block_rules", "block_rules"),
)
def j3_rules(spark, sf_dir):
    return M.classify_blocklist(blocklist(spark, sf_dir))


@query("j4_brand_title_join", O.with_ctes("SELECT request_id, brand FROM brand_hits", "brand_hits"))
def j4(spark, sf_dir):
    return R.page_signals(V.traffic(spark, sf_dir), {"unencrypted_connection": False}).filter(
        "brand_hit is not null"
    ).select("request_id", F.col("brand_hit").alias("brand"))


@query("j5_typosquat_join", O.with_ctes("SELECT host, kind, official FROM typo_hits", "typo_hits"))
def j5(spark, sf_dir):
    hosts = M.with_labels(M.distinct_hosts(html_view(spark, sf_dir)))
    hit = M.typosquat_hit(F.col("host"), F.col("own"), F.col("plain"))
    return hosts.select("host", hit.alias("hit")).filter("hit is not null").select("host", "hit.kind", "hit.official")


@query("j5_typosquat_by_join", O.with_ctes("SELECT host, kind, official FROM typo_hits", "typo_hits"))
def j5_join(spark, sf_dir):
    return M.typosquat_hits(M.distinct_hosts(html_view(spark, sf_dir)), dims.brand_domains(spark))


@query(
    "j5_similar_labels",
    O.with_ctes(
        """SELECT DISTINCT w.label, b.label AS official FROM (
             SELECT DISTINCT lower(p_name) AS label FROM (SELECT unnest(string_split(c_name, ' ')) AS p_name FROM (
               SELECT DISTINCT unnest(string_split(lower(title), ' ')) AS c_name FROM titles))) w, brands b
           WHERE length(w.label) >= 3 AND length(b.label) >= 3 AND abs(length(w.label) - length(b.label)) <= 2
             AND (levenshtein(w.label, b.label) = 1 OR (levenshtein(w.label, b.label) = 2
                  AND w.label[1] = b.label[1] AND w.label[-1] = b.label[-1]))""",
        "typo_hits",
    ),
)
def j5_similar(spark, sf_dir):
    """Words of page titles beside the official labels."""
    titles = P.page_titles(html_view(spark, sf_dir), "request_id")
    words = titles.select(F.explode(F.split(F.lower("title"), " ")).alias("label"))
    return M.similar_labels(words, dims.brand_domains(spark).select("label"))


@query(
    "j6_analysis_rule_join",
    O.from_views(
        """SELECT a.analysis_id, a.event_id, a.rule_code, a.rule_score, a.details, r.rule_type, r.weight
           FROM rules_analysis a LEFT JOIN rules r ON a.rule_code = r.rule_code""",
        "rules_analysis",
        extra=RULES_X,
    ),
)
def j6(spark, sf_dir):
    return A.analysis_shape(A.analyses_with_rule(analyses(spark, sf_dir), rules(spark)))


@query(
    "j7_sessions_with_risk",
    O.from_views(
        """SELECT s.session_id, s.agent_name, s.user_id, round(coalesce(avg(e.risk_score), 0), 12) AS average_risk_score
           FROM sessions s LEFT JOIN guard_events e ON e.session_id = s.session_id GROUP BY ALL""",
        "sessions", "guard_events",
    ),
)
def j7(spark, sf_dir):
    return A.sessions_with_risk(sessions(spark, sf_dir), guard_events(spark, sf_dir)).select(
        "session_id", "agent_name", "user_id", F.round("average_risk_score", 12).alias("average_risk_score")
    )


@query(
    "j8_sessions_with_user",
    O.from_views(
        "SELECT s.session_id, s.user_id, u.username FROM sessions s LEFT JOIN users u ON u.user_id = s.user_id",
        "sessions", "users",
    ),
)
def j8(spark, sf_dir):
    return A.sessions_with_user(sessions(spark, sf_dir), V.load(spark, sf_dir, "users")).select(
        "session_id", "user_id", "username"
    )


ROTATED = {
    "moves": "SELECT * FROM lifecycle WHERE action IN ('start', 'stop')",
    "rotated": """
        SELECT * FROM (SELECT event_id AS session_id, action, ts AS start_time, environment, agent_name,
               lead(ts) OVER w AS end_time, lead(action) OVER w AS next_action,
               CASE WHEN lag(action) OVER w = 'start' THEN lag(event_id) OVER w END AS replaced_session_id
        FROM moves WINDOW w AS (PARTITION BY agent_name, environment ORDER BY ts, event_id)) WHERE action = 'start'""",
    "asked": """
        SELECT l.event_id, l.ts, l.agent_name, l.environment, max(r.session_id) AS session_id
        FROM lifecycle l LEFT JOIN rotated r ON r.agent_name = l.agent_name AND r.environment = l.environment
          AND r.start_time <= l.ts AND (r.end_time IS NULL OR l.ts < r.end_time)
        WHERE l.action = 'request' GROUP BY ALL""",
}


def rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rotate_sessions(V.load(spark, sf_dir, "lifecycle"))


def session_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.load(spark, sf_dir, "lifecycle").filter("action = 'request'").drop("action")


@query(
    "j9_session_attribution",
    O.from_views("SELECT event_id, session_id AS open_session_id FROM asked", "lifecycle", extra=ROTATED),
)
def j9(spark, sf_dir):
    return S.open_session_at(session_requests(spark, sf_dir), rotated(spark, sf_dir)).select("event_id", "open_session_id")


@query(
    "j9_overlapping_sessions",
    O.from_views(
        """SELECT l.event_id, max(s.session_id) AS open_session_id FROM lifecycle l
           LEFT JOIN sessions s ON s.agent_name = l.agent_name AND s.environment = l.environment
             AND s.start_time <= l.ts AND (s.end_time IS NULL OR l.ts < s.end_time)
           WHERE l.action = 'request' GROUP BY l.event_id""",
        "lifecycle", "sessions",
    ),
)
def j9_overlap(spark, sf_dir):
    return S.open_session_at(session_requests(spark, sf_dir), sessions(spark, sf_dir)).select("event_id", "open_session_id")


@query(
    "j10_orphan_events",
    O.from_views(
        """SELECT event_id, session_id, 'Session not found' AS error FROM guard_events e
           WHERE NOT EXISTS (SELECT 1 FROM rotated r WHERE r.session_id = e.session_id)""",
        "guard_events", "lifecycle", extra=ROTATED,
    ),
)
def j10(spark, sf_dir):
    return K.orphan_events(guard_events(spark, sf_dir), rotated(spark, sf_dir)).select("event_id", "session_id", "error")


@query(
    "j10_orphan_analyses",
    O.from_views(
        """SELECT a.analysis_id, a.event_id, a.rule_code,
                  CASE WHEN e.event_id IS NULL THEN 'Referenced event does not exist' ELSE 'Referenced rule does not exist' END AS error
           FROM rules_analysis a LEFT JOIN (SELECT event_id FROM guard_events WHERE guard_action <> 'Block') e ON e.event_id = a.event_id
           LEFT JOIN rules r ON r.rule_code = a.rule_code WHERE e.event_id IS NULL OR r.rule_code IS NULL""",
        "rules_analysis", "guard_events", extra=RULES_X,
    ),
)
def j10_analyses(spark, sf_dir):
    kept = guard_events(spark, sf_dir).filter("guard_action <> 'Block'")
    return K.orphan_analyses(analyses(spark, sf_dir), kept, rules(spark)).select(
        "analysis_id", "event_id", "rule_code", "error"
    )


@query(
    "j11_verdict_as_of",
    O.from_views(
        """SELECT r.request_id, r.domain,
                  CASE WHEN v.observed_at > r.ts - INTERVAL 1 HOUR THEN v.listed END AS listed
           FROM verdict_requests r ASOF LEFT JOIN verdicts v ON v.domain = r.domain AND v.observed_at <= r.ts""",
        "verdicts", "verdict_requests",
    ),
)
def j11(spark, sf_dir):
    asked = V.load(spark, sf_dir, "verdict_requests").withColumnRenamed("ts", "timestamp")
    return M.verdicts_as_of(asked, V.load(spark, sf_dir, "verdicts")).drop("source")


@query(
    "j12_rule_enablement",
    O.from_views(
        """SELECT c.rule_code, c.n, coalesce(r.is_enabled, TRUE) AS is_enabled
           FROM (SELECT rule_code, count(*) AS n FROM rules_analysis GROUP BY rule_code) c
           LEFT JOIN (SELECT rule_code, rule_code <> 'typosquatting' AS is_enabled FROM rules) r ON r.rule_code = c.rule_code""",
        "rules_analysis", extra=RULES_X,
    ),
)
def j12(spark, sf_dir):
    codes = analyses(spark, sf_dir).groupBy("rule_code").agg(F.count("*").alias("n"))
    table = rules(spark).withColumn("is_enabled", F.col("rule_code") != "typosquatting")
    return K.with_enablement(codes, table)


# ------------------------------------------------------------------ R rules
def _rule(name: str, rule_id: str) -> None:
    hit, why = O._verdict_sql()[rule_id]

    @query(name, O.with_ctes(
        f"SELECT request_id, CASE WHEN coalesce({hit}, FALSE) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, {why} AS explanation FROM signals",
        "signals",
    ))
    def run(spark, sf_dir):
        only = {r.rule_id: r.rule_id == rule_id for r in dims.RULE_REGISTRY}
        rows = R.evaluate(V.traffic(spark, sf_dir), feed(spark, sf_dir), blocklist(spark, sf_dir), only)
        own = F.filter("rule_results", lambda r: r["rule_id"] == rule_id)[0]
        return rows.select("request_id", own["score"].alias("score"), own["explanation"].alias("explanation"))


_rule("r1_domain_blacklist", "domain_blacklist")
_rule("r2_unencrypted_connection", "unencrypted_connection")
_rule("r3_sensitive_fields", "sensitive_fields")
_rule("r4_brand_domain_mismatch", "brand_domain_mismatch")
_rule("r5_unexpected_redirect", "unexpected_redirect")
_rule("r6_external_form_action", "external_form_action")
_rule("r7_typosquatting", "typosquatting")
_rule("r8_ip_based_url", "ip_based_url")
_rule("r9_custom_blacklist", "custom_blacklist")

SCORED_COLUMNS = "request_id, url, decision, risk_score, hard_block_triggered, coalesce(stage_b_required, FALSE) AS stage_b_required"


def _scored_columns(df: DataFrame) -> DataFrame:
    return df.select("request_id", "url", "decision", "risk_score", "hard_block_triggered", "stage_b_required")


@query("r10_evaluate", O.scoring(f"SELECT {SCORED_COLUMNS} FROM scored"))
def r10(spark, sf_dir):
    return _scored_columns(scored(spark, sf_dir))


@query("r10_evaluate_some_rules", O.scoring(f"SELECT {SCORED_COLUMNS} FROM scored", O.SOFT))
def r10_soft(spark, sf_dir):
    return _scored_columns(scored(spark, sf_dir, SOFT))


@query(
    "r11_weighted_score",
    O.scoring("SELECT p.request_id, round(s.raw, 9) AS score FROM pages_x p JOIN raw_scores s USING (request_id)", O.SOFT),
)
def r11(spark, sf_dir):
    results = scored(spark, sf_dir, SOFT)

    def score_of(rule_id: str) -> Column:
        return F.filter("rule_results", lambda x: x["rule_id"] == rule_id)[0]["score"]

    terms = [(score_of(r.rule_id), r.weight) for r in dims.RULE_REGISTRY if r.rule_id in O.SOFT]
    return results.select("request_id", F.round(R.weighted_score(terms), 9).alias("score"))


@query(
    "r12_decision_bands",
    O.from_views(
        """SELECT event_id, CASE WHEN risk_score >= 0.7 THEN 'block' WHEN risk_score >= 0.4 THEN 'warn' ELSE 'allow' END AS decision,
                  risk_score >= 0.4 AND risk_score < 0.7 AS stage_b_required FROM guard_events""",
        "guard_events",
    ),
)
def r12(spark, sf_dir):
    score = F.col("risk_score")
    return guard_events(spark, sf_dir).select(
        "event_id", R.decide(score).alias("decision"), R.needs_second_stage(score).alias("stage_b_required")
    )


LONG = "request_id, ordinal::BIGINT AS ordinal, rule_id, score, hard_block, explanation, coalesce(triggered, FALSE) AS triggered"


@query("r13_rule_results", O.scoring(f"SELECT {LONG} FROM long"))
def r13(spark, sf_dir):
    return R.rule_results(scored(spark, sf_dir)).drop("rule_type").withColumn("ordinal", long("ordinal"))


@query("r13_rule_results_some_rules", O.scoring(f"SELECT {LONG} FROM long", ["sensitive_fields", "ip_based_url", "unencrypted_connection"]))
def r13_some(spark, sf_dir):
    some = {r.rule_id: r.rule_id in ("sensitive_fields", "ip_based_url", "unencrypted_connection") for r in dims.RULE_REGISTRY}
    return R.rule_results(scored(spark, sf_dir, some)).drop("rule_type").withColumn("ordinal", long("ordinal"))


REASONS = {
    "details": f"""
        SELECT request_id, arg_min(explanation, ordinal) FILTER (WHERE triggered AND hard_block) AS hard,
               array_to_string((list(explanation ORDER BY ordinal) FILTER (WHERE triggered))[1:3], '; ') AS few
        FROM long GROUP BY request_id""",
    "reasons": f"""
        SELECT s.*, CASE WHEN s.decision = 'block' THEN
                 CASE WHEN coalesce(d.hard, nullif(d.few, '')) IS NULL THEN {O.q(E.BLOCKED)}
                      ELSE {O.q(E.BLOCKED)} || chr(10) || chr(10) || 'Reason: ' || coalesce(d.hard, nullif(d.few, '')) END
               WHEN s.decision = 'warn' THEN {O.q(E.WARNED)} ELSE {O.q(E.APPROVED)} END AS reason
        FROM scored s LEFT JOIN details d USING (request_id)""",
    # The fate of the call: no answer for one method, failures for three groups of addresses.
    "calls": """
        SELECT *, CASE WHEN url LIKE '%.example.net%' THEN 'timeout' WHEN url LIKE '%.example.org%' THEN 'unreachable'
                       WHEN url LIKE 'https://bank.com%' THEN 'bad' END AS error,
               method = 'OPTIONS' AS lost FROM reasons""",
}


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    error = (
        F.when(F.contains(url, F.lit(".example.net")), F.lit("timeout"))
        .when(F.contains(url, F.lit(".example.org")), F.lit("unreachable"))
        .when(url.startswith("https://bank.com"), F.lit("bad"))
    )
    answered = scored(spark, sf_dir).filter("method <> 'OPTIONS'")
    return answered.select("request_id", "decision", "rule_results", error.alias("error"))


def _enforced_sql(open_mode: bool, passive: bool) -> str:
    source = """CASE WHEN lost OR error = 'unreachable' THEN 'backend_unreachable' WHEN error = 'timeout' THEN 'backend_timeout'
                     WHEN error = 'bad' THEN 'backend_error' ELSE 'backend' END"""
    failed = "'allow'" if open_mode else "'block'"
    reason = O.q(E.OPEN) if open_mode else f"CASE WHEN source = 'backend_error' THEN {O.q(E.INVALID)} ELSE {O.q(E.UNAVAILABLE)} END"
    status = "NULL" if open_mode else "503"
    applied = "FALSE" if passive else "decision = 'block'"
    return f"""SELECT request_id, CASE WHEN source = 'backend' THEN decision ELSE {failed} END AS decision,
                      CASE WHEN source = 'backend' THEN reason ELSE {reason} END AS reason, source,
                      CAST(CASE WHEN source = 'backend' THEN CASE WHEN {applied} THEN 403 END ELSE {status} END AS BIGINT) AS status_code
               FROM (SELECT *, {source} AS source FROM calls)"""


def _enforce(name: str, mode: str, passive: bool) -> None:
    sql = O.with_ctes(_enforced_sql(mode == "fail_open", passive), "signals", O.scored_ctes() | REASONS)

    @query(name, sql)
    def run(spark, sf_dir):
        rows = E.enforcement(html_view(spark, sf_dir), decisions(spark, sf_dir), mode, passive)
        return rows.drop("rule_results").withColumn("status_code", long("status_code"))


_enforce("r14_enforcement_fail_closed", "fail_closed", False)
_enforce("r14_enforcement_fail_open_passive", "fail_open", True)


@query(
    "r15_block_reason",
    O.with_ctes(
        "SELECT request_id, reason FROM reasons WHERE decision = 'block'", "signals", O.scored_ctes() | REASONS
    ),
)
def r15(spark, sf_dir):
    return scored(spark, sf_dir).filter("decision = 'block'").select(
        "request_id", E.block_reason(F.col("rule_results")).alias("reason")
    )


@query("r16_triggered_evidence", O.scoring("SELECT request_id, rule_id, score, explanation FROM long WHERE score <> 0"))
def r16(spark, sf_dir):
    return R.rule_results(R.triggered_evidence(scored(spark, sf_dir))).select(
        "request_id", "rule_id", "score", "explanation"
    )


@query(
    "c16_response_records",
    O.with_ctes(
        f"""SELECT p.request_id, {O.iso('p.ts')} AS timestamp, 'RESPONSE' AS type, p.status_code::BIGINT AS status_code, p.url, s.decision, s.risk_score,
                   (SELECT count(*) FROM long l WHERE l.request_id = p.request_id) AS rules, e.decision AS enforced, e.reason, e.source
            FROM pages_x p JOIN scored s ON s.request_id = p.request_id LEFT JOIN ({_enforced_sql(False, False)}) e ON e.request_id = p.request_id""",
        "signals", O.scored_ctes() | REASONS,
    ),
)
def c16(spark, sf_dir):
    """Each response with its evaluation and the enforcement of its request; bodies are pruned before the joins."""
    records = A.response_shape(
        V.traffic(spark, sf_dir), scored(spark, sf_dir), E.enforcement(html_view(spark, sf_dir), decisions(spark, sf_dir), "fail_closed", False)
    )
    return records.select(
        "request_id", "timestamp", "type", long("status_code").alias("status_code"), "url", "evaluation.decision", "evaluation.risk_score",
        long(F.size("evaluation.rule_results")).alias("rules"), F.col("request_enforcement.decision").alias("enforced"),
        "request_enforcement.reason", "request_enforcement.source",
    )


@query(
    "c13_lower_case_headers",
    O.with_ctes(
        """SELECT request_id, user_agent, CASE WHEN method = 'POST' THEN lower(content_type) ELSE content_type END AS content_type, 2 AS names FROM pages_x""",
        "pages_x",
    ),
)
def c13(spark, sf_dir):
    """Names in any case; of two that collide the later one counts."""
    page = V.load(spark, sf_dir, "traffic")
    once = F.create_map(F.lit("User-Agent"), "user_agent", F.lit("Content-Type"), "content_type")
    twice = F.map_concat(once, F.create_map(F.lit("CONTENT-TYPE"), F.lower("content_type")))
    headers = X.lower_keys(F.when(F.col("method") == "POST", twice).otherwise(once))
    return page.select("request_id", headers.alias("h")).select(
        "request_id", F.col("h")["user-agent"].alias("user_agent"), F.col("h")["content-type"].alias("content_type"), long(F.size("h")).alias("names")
    )


@query(
    "c14_agents_from_headers",
    O.with_ctes(
        """SELECT request_id, CASE request_id % 4 WHEN 0 THEN agent_name WHEN 1 THEN 'second-' || request_id WHEN 2 THEN 'first-' || request_id END AS agent_name
           FROM pages_x""",
        "pages_x",
    ),
)
def c14(spark, sf_dir):
    """The agent of a request that does not name one, from two headers in this order of precedence."""
    page = F.col("request_id")
    first = F.concat(F.lit("first-"), page)
    headers = (
        F.when(page % 4 == 1, F.create_map(F.lit("x-second"), F.concat(F.lit("second-"), page), F.lit("X-First"), F.lit("")))
        .when(page % 4 == 2, F.create_map(F.lit("X-Second"), F.lit("other"), F.lit("X-FIRST"), first))
        .otherwise(F.create_map(F.lit("X-Third"), F.lit("none")))
    )
    named = F.when(page % 4 == 0, F.col("agent_name"))
    raw = V.traffic(spark, sf_dir).withColumns({"agent_name": named, "req_headers": headers})
    return readers.finish_traffic(raw, ("X-First", "X-Second")).select("request_id", "agent_name")


@query(
    "c17_displayed_weights",
    O.from_views(
        """SELECT r.rule_code, round(r.weight * c.n / (SELECT count(*) FROM rules_analysis), 4) AS weight
           FROM rules r JOIN (SELECT rule_code, count(*) AS n FROM rules_analysis GROUP BY rule_code) c ON c.rule_code = r.rule_code""",
        "rules_analysis", extra=RULES_X,
    ),
)
def c17(spark, sf_dir):
    """Weights as they are shown, each scaled by the share of the analyses that its rule has."""
    counts = analyses(spark, sf_dir).groupBy("rule_code").agg(F.count("*").alias("n"))
    every = counts.agg(F.sum("n")).scalar()
    weight = F.col("weight") * F.col("n") / every
    return rules(spark).join(counts, "rule_code").select("rule_code", X.display_weight(weight).alias("weight"))


# The responses that are analysed, in the form of the traffic that the scoring reads.
RESPONSES = {
    "traffic": """
        SELECT request_id, url, resp_body AS html, method, status_code, TIMESTAMP '2024-01-01 00:00:00' AS ts, 'prod' AS environment,
               'agent' AS agent_name, resp_type AS content_type, user_agent
        FROM weblog_verdicts WHERE NOT ignored""",
}


@query(
    "r17_response_evaluations",
    O.with_ctes(
        "SELECT s.request_id, s.decision, s.risk_score, l.rule_id, l.score, l.explanation FROM scored s JOIN long l USING (request_id)",
        "signals", RESPONSES | O.scored_ctes(),
    ),
)
def r17(spark, sf_dir):
    rows = R.evaluate_responses(V.weblog(spark, sf_dir), filter_list(spark, sf_dir), feed(spark, sf_dir), blocklist(spark, sf_dir))
    results = F.inline("rule_results")
    return rows.select("request_id", "decision", "risk_score", results).select(
        "request_id", "decision", "risk_score", "rule_id", "score", "explanation"
    )


@query(
    "e1_registered_rule",
    O.with_ctes(
        """SELECT s.request_id, round((s.raw * 1.55 + CASE WHEN p.method = 'POST' THEN 0.45 ELSE 0 END) / 2.0, 4) AS risk_score
           FROM raw_scores s JOIN pages_x p USING (request_id) LEFT JOIN hard h USING (request_id) WHERE h.first_hard IS NULL""",
        "signals", O.scored_ctes(),
    ),
)
def e1(spark, sf_dir):
    def posts():
        hit = F.col("method") == "POST"
        return F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0)), F.when(hit, F.lit("posts data")).otherwise(F.lit("reads"))

    book = R.RuleBook().register_rule("posts_data", "Request posts data", 0.45, False, posts)
    rows = R.evaluate(V.traffic(spark, sf_dir), feed(spark, sf_dir), blocklist(spark, sf_dir), book=book)
    return rows.filter(~F.col("hard_block_triggered")).select("request_id", "risk_score")


# ------------------------------------------------------------------ A aggregations
STATS_SQL = """SELECT s.session_id, count(e.event_id) AS total_events, count(*) FILTER (WHERE e.guard_action = 'Allow') AS allow,
       count(*) FILTER (WHERE e.guard_action = 'Warn') AS warn, count(*) FILTER (WHERE e.guard_action = 'Block') AS block,
       round(coalesce(avg(e.risk_score), 0), 12) AS average_risk_score
FROM sessions s LEFT JOIN guard_events e ON e.session_id = s.session_id GROUP BY s.session_id"""


@query("a1_session_stats", O.from_views(STATS_SQL, "sessions", "guard_events"))
def a1(spark, sf_dir):
    return A.session_stats(sessions(spark, sf_dir), guard_events(spark, sf_dir)).withColumn(
        "average_risk_score", F.round("average_risk_score", 12)
    )


@query("a2_rule_counts", O.scoring("SELECT request_id, rule_count, triggered_rule_count FROM scored"))
def a2(spark, sf_dir):
    return R.rule_counts(scored(spark, sf_dir)).withColumns(
        {"rule_count": long("rule_count"), "triggered_rule_count": long("triggered_rule_count")}
    )


@query(
    "a3_facet_values",
    O.from_views("SELECT DISTINCT details AS value FROM rules_analysis WHERE details <> '' ORDER BY value", "rules_analysis"),
)
def a3(spark, sf_dir):
    return A.facet_values(analyses(spark, sf_dir), "details")


@query(
    "a4_official_labels",
    O.with_ctes(
        """SELECT b.label, count(l.host) AS hosts FROM (SELECT DISTINCT label FROM brands) b
           LEFT JOIN labels_x l ON l.plain = b.label GROUP BY b.label""",
        "labels_x",
    ),
)
def a4(spark, sf_dir):
    plain = U.sld_label(U.normalize_confusables(U.strip_www(F.col("host"))))
    hosts = M.distinct_hosts(html_view(spark, sf_dir)).groupBy(plain.alias("label")).agg(F.count("*").alias("hosts"))
    return dims.brand_domains(spark).select("label").distinct().join(hosts, "label", "left").fillna({"hosts": 0})


@query(
    "a5_risk_levels",
    O.from_views(
        f"""SELECT CASE WHEN a > 0.7 THEN 'high' WHEN a > 0.4 THEN 'medium' ELSE 'low' END AS risk_level, count(*) AS n
            FROM (SELECT risk_score AS a FROM guard_events UNION ALL SELECT average_risk_score FROM ({STATS_SQL})) GROUP BY 1""",
        "sessions", "guard_events",
    ),
)
def a5(spark, sf_dir):
    events = guard_events(spark, sf_dir)
    per_session = A.sessions_with_risk(sessions(spark, sf_dir), events).select("average_risk_score")
    return A.risk_levels(events.select(F.col("risk_score").alias("average_risk_score")).unionByName(per_session))


# ------------------------------------------------------------------ W session context and life cycle
CONTEXT = {
    "visits": f"""
        SELECT event_id, session_id, ts, url, guard_action <> 'Allow' AS sensitive,
               row_number() OVER (PARTITION BY session_id, {O.host('url')} ORDER BY ts, event_id) = 1 AS fresh FROM guard_events""",
    "context": """
        SELECT event_id, session_id, ts, url, row_number() OVER w - 1 AS position,
               coalesce(array_to_string(list(url) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ' '), '') AS latest_urls,
               coalesce(count(*) FILTER (WHERE sensitive) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sensitive_interaction_count,
               coalesce(count(*) FILTER (WHERE fresh) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unique_domains_visited
        FROM visits WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)""",
}


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = guard_events(spark, sf_dir).select(
        "event_id", "session_id", "timestamp", "url", (F.col("guard_action") != "Allow").alias("sensitive")
    )
    return S.session_context(rows)


def _context(name: str, column: str) -> None:
    @query(name, O.from_views(f"SELECT event_id, session_id, {column} FROM context", "guard_events", extra=CONTEXT))
    def run(spark, sf_dir):
        return context(spark, sf_dir).select("event_id", "session_id", long(column).alias(column))


_context("w1_event_positions", "position")
_context("w2_sensitive_interactions", "sensitive_interaction_count")
_context("w3_unique_domains", "unique_domains_visited")


@query(
    "w1_previous_urls",
    O.from_views(
        """SELECT event_id, session_id,
                  coalesce(array_to_string(list(url) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ' '), '') AS previous_urls
           FROM guard_events WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)""",
        "guard_events",
    ),
)
def w1(spark, sf_dir):
    """The whole history of every event."""
    events = guard_events(spark, sf_dir).select("event_id", "session_id", "timestamp", "url")
    return S.whole_histories(events).select("event_id", "session_id", F.array_join("previous_urls", " ").alias("previous_urls"))


@query(
    "w1_newest_history",
    O.from_views(
        """SELECT n.event_id, c.session_id, c.position, c.url FROM context c
           JOIN (SELECT session_id, arg_max(event_id, (ts, event_id)) AS event_id, max(position) AS position FROM context GROUP BY session_id) n
             ON n.session_id = c.session_id AND c.position < n.position""",
        "guard_events", extra=CONTEXT,
    ),
)
def w1_newest(spark, sf_dir):
    """The history of the event under evaluation, which is the newest one of its session."""
    every = checkpoint(context(spark, sf_dir))
    newest = every.groupBy("session_id").agg(F.max_by("event_id", "position").alias("event_id"))
    return S.previous_urls(every, newest)


@query("w1_latest_urls", O.from_views("SELECT event_id, latest_urls FROM context", "guard_events", extra=CONTEXT))
def w1_latest(spark, sf_dir):
    found = S.latest_urls(checkpoint(context(spark, sf_dir)), 5)
    return found.select("event_id", F.array_join("previous_urls", " ").alias("latest_urls"))


@query(
    "w4_session_rotation",
    O.from_views(
        f"""SELECT session_id, {O.iso_us('start_time')} AS start_time, {O.iso_us('end_time')} AS end_time, environment, agent_name,
                   replaced_session_id, CASE next_action WHEN 'start' THEN {O.q(S.SUPERSEDED)} WHEN 'stop' THEN {O.q(S.STOPPED)} END AS end_reason
            FROM rotated""",
        "lifecycle", extra=ROTATED,
    ),
)
def w4(spark, sf_dir):
    return rotated(spark, sf_dir).drop("user_id").withColumns(
        {"start_time": iso_us("start_time"), "end_time": iso_us("end_time")}
    )


@query(
    "w4_session_records",
    O.from_views(
        f"""SELECT {O.iso('start_time')} AS timestamp, agent_name AS agent, environment, session_id, 'proxy_session_started' AS event,
                   replaced_session_id, NULL AS reason FROM rotated
            UNION ALL
            SELECT {O.iso('end_time')}, agent_name, environment, session_id, 'proxy_session_closed', NULL,
                   CASE next_action WHEN 'start' THEN {O.q(S.SUPERSEDED)} ELSE {O.q(S.STOPPED)} END FROM rotated WHERE end_time IS NOT NULL""",
        "lifecycle", extra=ROTATED,
    ),
)
def w4_records(spark, sf_dir):
    return S.session_records(rotated(spark, sf_dir))


@query(
    "w5_latest_open_session",
    O.from_views(
        "SELECT agent_name, environment, max(session_id) AS session_id FROM sessions WHERE end_time IS NULL GROUP BY ALL", "sessions"
    ),
)
def w5(spark, sf_dir):
    return S.latest_open_sessions(sessions(spark, sf_dir))


# ------------------------------------------------------------------ T listings
EVENT_SHAPE = f"event_id, {O.iso('ts')} AS timestamp, url, guard_action, risk_score, http_method"


def _shaped_events(events: DataFrame) -> DataFrame:
    return A.event_shape(readers.with_headers(events)).drop("headers")


@query("t1_all_events", O.from_views(f"SELECT {EVENT_SHAPE} FROM guard_events ORDER BY ts DESC, event_id DESC", "guard_events"))
def t1(spark, sf_dir):
    return _shaped_events(A.all_events(guard_events(spark, sf_dir)))


@query(
    "t1_session_events",
    O.from_views(f"SELECT {EVENT_SHAPE} FROM guard_events WHERE session_id = 7 ORDER BY ts, event_id", "guard_events"),
)
def t1_session(spark, sf_dir):
    return _shaped_events(A.session_events(guard_events(spark, sf_dir), 7))


@query(
    "t2_session_list",
    O.from_views(
        f"""SELECT session_id, user_id, {O.iso('start_time')} AS start_time, agent_name, {O.iso('end_time')} AS end_time, environment
            FROM sessions ORDER BY session_id DESC""",
        "sessions",
    ),
)
def t2(spark, sf_dir):
    return A.session_shape(A.session_list(sessions(spark, sf_dir)))


@query(
    "t3_rule_list",
    O.from_views(
        """SELECT rule_code, weight, rule_type, compute_class, is_enabled, is_hard_block, description FROM (
             SELECT * FROM rules UNION ALL
             SELECT DISTINCT a.rule_code, 0.0::DOUBLE, 'deterministic', 'cheap', TRUE, FALSE, 'seen in analyses' FROM rules_analysis a
             WHERE a.rule_code NOT IN (SELECT rule_code FROM rules)) ORDER BY rule_code""",
        "rules_analysis", extra=RULES_X,
    ),
)
def t3(spark, sf_dir):
    seen = analyses(spark, sf_dir).select(
        F.col("rule_code").alias("rule_id"), F.lit("deterministic").alias("rule_type"),
        F.lit(False).alias("hard_block"), F.lit("seen in analyses").alias("explanation"),
    )
    table = K.register_missing_rules(rules(spark), K.rules_from_results(seen))
    return A.rule_shape(A.rule_list(table))


@query(
    "t4_event_analyses",
    O.from_views(
        """SELECT a.analysis_id, a.event_id, a.rule_code, a.rule_score, a.details, r.rule_type, r.weight FROM rules_analysis a
           LEFT JOIN rules r ON r.rule_code = a.rule_code WHERE a.event_id = 40 ORDER BY a.analysis_id""",
        "rules_analysis", extra=RULES_X,
    ),
)
def t4(spark, sf_dir):
    return A.analysis_shape(A.event_analyses(analyses(spark, sf_dir), rules(spark), 40))


@query(
    "t5_latest_analyses",
    O.from_views(
        """SELECT a.analysis_id, a.event_id, a.rule_code, a.rule_score, a.details, r.rule_type, r.weight FROM rules_analysis a
           LEFT JOIN rules r ON r.rule_code = a.rule_code WHERE a.rule_code = 'typosquatting' ORDER BY a.analysis_id DESC LIMIT 100""",
        "rules_analysis", extra=RULES_X,
    ),
)
def t5(spark, sf_dir):
    return A.analysis_shape(A.latest_analyses(analyses(spark, sf_dir), rules(spark), "typosquatting"))


@query(
    "t5_latest_analyses_per_rule",
    O.from_views(
        """SELECT a.analysis_id, a.rule_code, r.weight, a.place FROM (
             SELECT *, row_number() OVER (PARTITION BY rule_code ORDER BY analysis_id DESC) AS place FROM rules_analysis) a
           LEFT JOIN rules r ON r.rule_code = a.rule_code WHERE a.place <= 100""",
        "rules_analysis", extra=RULES_X,
    ),
)
def t5_all(spark, sf_dir):
    return A.latest_analyses_per_rule(analyses(spark, sf_dir), rules(spark)).select(
        "analysis_id", "rule_code", "weight", long("place").alias("place")
    )


@query("t6_event_lookup", O.from_views(f"SELECT {EVENT_SHAPE} FROM guard_events WHERE event_id = 123", "guard_events"))
def t6(spark, sf_dir):
    return _shaped_events(A.lookup(guard_events(spark, sf_dir), "event_id", 123))


# ------------------------------------------------------------------ U changes
@query(
    "u1_register_rules",
    O.from_views(
        """SELECT * FROM (SELECT * FROM rules WHERE is_hard_block) UNION ALL
           SELECT rule_code, weight, 'contextual', compute_class, TRUE, FALSE, description FROM rules
           WHERE NOT is_hard_block AND rule_code IN (SELECT rule_code FROM rules_analysis) UNION ALL
           SELECT rule_code, 0.0::DOUBLE, 'contextual', 'cheap', TRUE, FALSE, left(min(details), 255) FROM rules_analysis
           WHERE rule_code NOT IN (SELECT rule_code FROM rules) GROUP BY rule_code""",
        "rules_analysis", extra=RULES_X,
    ),
)
def u1(spark, sf_dir):
    seen = analyses(spark, sf_dir).select(
        F.col("rule_code").alias("rule_id"), F.lit("contextual").alias("rule_type"),
        F.lit(False).alias("hard_block"), F.col("details").alias("explanation"),
    )
    return K.register_missing_rules(rules(spark).filter("is_hard_block"), K.rules_from_results(seen))


U2_X = RULES_X | {
    "changes": "SELECT rule_code, count(*) % 2 = 0 AS is_enabled FROM rules_analysis GROUP BY rule_code",
}


def _rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses(spark, sf_dir).groupBy("rule_code").agg((F.count("*") % 2 == 0).alias("is_enabled"))


@query(
    "u2_set_rules_enabled",
    O.from_views(
        """SELECT r.rule_code, coalesce(c.is_enabled, r.is_enabled) AS is_enabled, FALSE AS unknown
           FROM rules r LEFT JOIN changes c ON c.rule_code = r.rule_code
           UNION ALL SELECT rule_code, is_enabled, TRUE FROM changes WHERE rule_code NOT IN (SELECT rule_code FROM rules)""",
        "rules_analysis", extra=U2_X,
    ),
)
def u2(spark, sf_dir):
    changes = _rule_changes(spark, sf_dir)
    snapshot, unknown = K.set_rules_enabled(rules(spark), changes)
    return snapshot.select("rule_code", "is_enabled", F.lit(False).alias("unknown")).unionByName(
        unknown.join(changes, "rule_code").select("rule_code", "is_enabled", F.lit(True).alias("unknown"))
    )


CLOSES = {
    "closes": "SELECT event_id AS request_id, user_id + 20 AS session_id, ts AS end_time FROM events WHERE event_type = 'purchase'",
    "wins": "SELECT session_id, min(end_time) AS end_time, arg_min(request_id, (end_time, request_id)) AS request_id FROM closes GROUP BY session_id",
}


def close_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'purchase'")
    return events.select(
        F.col("event_id").alias("request_id"), (F.col("user_id") + 20).alias("session_id"),
        F.col("ts").cast("timestamp").alias("end_time"),
    )


@query(
    "u3_close_sessions",
    O.from_views(
        f"""SELECT s.session_id, {O.iso_us('coalesce(s.end_time, w.end_time)')} AS end_time FROM sessions s LEFT JOIN wins w ON w.session_id = s.session_id""",
        "sessions", extra=CLOSES,
    ),
)
def u3(spark, sf_dir):
    snapshot, _ = S.close_sessions(sessions(spark, sf_dir), close_requests(spark, sf_dir))
    return snapshot.select("session_id", iso_us("end_time").alias("end_time"))


@query(
    "u3_close_outcomes",
    O.from_views(
        """SELECT c.request_id, c.session_id, CASE WHEN s.session_id IS NULL THEN 'not_found'
                  WHEN s.end_time IS NULL AND w.request_id = c.request_id THEN 'closed' ELSE 'already_closed' END AS outcome
           FROM closes c LEFT JOIN sessions s ON s.session_id = c.session_id LEFT JOIN wins w ON w.session_id = c.session_id""",
        "sessions", extra=CLOSES,
    ),
)
def u3_outcomes(spark, sf_dir):
    return S.close_sessions(sessions(spark, sf_dir), close_requests(spark, sf_dir))[1]


@query(
    "u4_overwrite_session_end",
    O.from_views(
        f"""SELECT s.session_id, {O.iso_us('coalesce(c.end_time, s.end_time)')} AS end_time FROM sessions s
            LEFT JOIN (SELECT session_id, arg_max(end_time, request_id) AS end_time FROM closes GROUP BY session_id) c ON c.session_id = s.session_id""",
        "sessions", extra=CLOSES,
    ),
)
def u4(spark, sf_dir):
    return S.overwrite_session_end(sessions(spark, sf_dir), close_requests(spark, sf_dir)).select(
        "session_id", iso_us("end_time").alias("end_time")
    )


@query(
    "u5_cascading_delete",
    O.from_views(
        """SELECT 'session' AS kind, session_id AS id FROM sessions WHERE environment = 'prod'
           UNION ALL SELECT 'event', event_id FROM guard_events WHERE session_id NOT IN (SELECT session_id FROM sessions WHERE environment <> 'prod')
           UNION ALL SELECT 'analysis', analysis_id FROM rules_analysis WHERE event_id NOT IN (SELECT event_id FROM guard_events
             WHERE session_id IN (SELECT session_id FROM sessions WHERE environment <> 'prod'))""",
        "sessions", "guard_events", "rules_analysis",
    ),
)
def u5(spark, sf_dir):
    every = sessions(spark, sf_dir)
    kept = S.delete_sessions(
        every, guard_events(spark, sf_dir), analyses(spark, sf_dir), every.filter("environment <> 'prod'")
    )
    parts = zip(("session", "event", "analysis"), kept, ("session_id", "event_id", "analysis_id"))
    frames = [df.select(F.lit(kind).alias("kind"), F.col(key).alias("id")) for kind, df, key in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "u5_delete_users",
    O.from_views(
        """SELECT session_id, CASE WHEN user_id NOT IN (SELECT user_id FROM users WHERE is_admin) THEN user_id END AS user_id FROM sessions""",
        "sessions", "users",
    ),
)
def u5_users(spark, sf_dir):
    users = V.load(spark, sf_dir, "users")
    return S.delete_users(users, sessions(spark, sf_dir), users.filter("is_admin"))[1].select("session_id", "user_id")


# ------------------------------------------------------------------ Q data quality
def _errors(name: str, view: str, spec: Q.Spec, case: str) -> None:
    @query(name, O.from_views(f"SELECT payload_id, {case} AS error FROM {view}", view))
    def run(spark, sf_dir):
        return Q.checked(V.load(spark, sf_dir, view), spec).select("payload_id", "error")


def _json(path: str, kind: str = "payload") -> str:
    return f"json_extract_string({kind}, '$.{path}')"


def _case(key: str, messages: dict[int, str], modulus: int) -> str:
    whens = " ".join(f"WHEN {k} THEN {O.q(m)}" for k, m in messages.items())
    return f"CASE {key} % {modulus} {whens} END"


_errors(
    "q1_traffic_quality", "traffic_payloads", Q.TRAFFIC,
    _case("payload_id", {
        1: "Missing required fields: method, headers",
        2: "'url' must be a non-empty string",
        3: "'method' must be a non-empty string",
        4: "'headers' must be an object",
        5: "'timestamp' must be a valid ISO-8601 datetime",
        6: "'environment' must be one of: prod, test",
        7: "'session_id' must be a positive integer",
        8: "'agent_name' must be a non-empty string when provided",
        9: "JSON request body is required",
    }, 13),
)
_errors(
    "q3_event_quality", "event_payloads", Q.EVENTS,
    "CASE WHEN payload_id % 13 IN (1, 5) THEN 'Invalid JSON body' "
    "WHEN payload_id % 13 = 2 THEN 'Invalid payload: url, headers must be an object' "
    "WHEN payload_id % 13 = 3 THEN 'Invalid payload: headers, method, timestamp, guard_action, risk_score' "
    "WHEN payload_id % 13 = 4 THEN 'Invalid payload: url, method, timestamp, guard_action, risk_score' "
    "WHEN json_extract_string(payload, '$.risk_score') = '7' THEN 'Invalid payload: risk_score' END",
)
_errors(
    "q5_analysis_quality", "analysis_payloads", Q.ANALYSES,
    _case("payload_id", {1: "Invalid event_id", 2: "Invalid rule_code", 3: "Invalid rule_score", 4: "Invalid details"}, 7),
)
_errors(
    "q6_session_quality", "session_payloads", Q.SESSIONS,
    _case("payload_id", {1: "Invalid or missing start_time", 2: "Missing agent_name", 3: "Invalid environment value"}, 5),
)


@query(
    "q1_valid_traffic",
    O.from_views(
        f"""SELECT payload_id, {_json('url')} AS url, upper({_json('method')}) AS method, {_json('headers.k')} AS k,
                   lower(trim({_json('environment')})) AS environment, CAST({_json('session_id')} AS BIGINT) AS session_id,
                   '2024-01-02T03:04:05Z' AS ts
            FROM traffic_payloads WHERE payload_id % 13 NOT BETWEEN 1 AND 9""",
        "traffic_payloads",
    ),
)
def q1_valid(spark, sf_dir):
    valid, _ = Q.split_valid(V.load(spark, sf_dir, "traffic_payloads"), Q.TRAFFIC)
    return valid.select(
        "payload_id", "url", "method", F.col("req_headers")["k"].alias("k"), "environment", "session_id",
        X.iso_z(F.col("timestamp")).alias("ts"),
    )


@query(
    "q2_traffic_sessions",
    O.from_views(
        """SELECT l.event_id, CASE WHEN explicit IS NULL THEN a.session_id ELSE explicit END AS session_id,
                  CASE WHEN explicit IS NULL THEN CASE WHEN a.session_id IS NULL THEN 'No active proxy session is available' END
                       WHEN s.session_id IS NULL THEN 'Provided session_id does not reference an existing session'
                       WHEN s.end_time IS NOT NULL AND l.ts >= s.end_time THEN 'Provided session_id is already closed'
                       WHEN l.environment <> s.environment THEN 'Provided environment does not match the referenced session'
                       WHEN l.agent_name <> s.agent_name THEN 'Provided agent_name does not match the referenced session' END AS error
           FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN event_id % 200 + 1 END AS explicit FROM lifecycle WHERE action = 'request') l
           LEFT JOIN sessions s ON s.session_id = l.explicit
           LEFT JOIN (SELECT l.event_id, max(o.session_id) AS session_id FROM lifecycle l JOIN sessions o
                      ON o.agent_name = l.agent_name AND o.environment = l.environment AND o.start_time <= l.ts
                        AND (o.end_time IS NULL OR l.ts < o.end_time) GROUP BY l.event_id) a ON a.event_id = l.event_id""",
        "lifecycle", "sessions",
    ),
)
def q2(spark, sf_dir):
    explicit = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 200 + 1)
    requests = session_requests(spark, sf_dir).withColumn("session_id", explicit)
    return S.attribute_sessions(requests, sessions(spark, sf_dir)).select("event_id", "session_id", "error")


@query(
    "q4_rule_quality",
    O.from_views(
        """SELECT payload_id, CASE payload_id % 11 WHEN 1 THEN 'Missing weight' WHEN 2 THEN 'Invalid rule_code' WHEN 3 THEN 'Invalid weight'
                  WHEN 4 THEN 'Invalid rule_type' WHEN 5 THEN 'Invalid compute_class' WHEN 6 THEN 'Invalid is_enabled'
                  WHEN 7 THEN 'Invalid is_hard_block' WHEN 8 THEN 'Invalid description' WHEN 9 THEN 'rule_code already exists'
                  ELSE CASE WHEN row_number() OVER (PARTITION BY payload_id % 11 IN (0, 10), json_extract_string(payload, '$.rule_code') ORDER BY payload_id) > 1
                            THEN 'rule_code already exists' END END AS error
           FROM rule_payloads""",
        "rule_payloads",
    ),
)
def q4(spark, sf_dir):
    valid, rejected = Q.split_new_rules(V.load(spark, sf_dir, "rule_payloads"), rules(spark), "payload_id")
    return rejected.select("payload_id", "error").unionByName(
        valid.select("payload_id", F.lit(None).cast("string").alias("error"))
    )


# ------------------------------------------------------------------ I intake of posted records, published tables
def _posted(kind: str, error: str, base: int = 0, more: str = "", column: str = "id") -> str:
    """Outcomes of a batch of even posts and then of all, a replay of half of them: ids go by batch and post."""
    codes = " ".join(f"WHEN {O.q(text)} THEN {code}" for text, code in N.STATUS.items())
    return f"""
        SELECT post_id, CASE WHEN error IS NULL THEN 201 ELSE CASE error {codes} ELSE 400 END END::BIGINT AS status,
               CASE WHEN error IS NULL THEN n END AS {column}, error
        FROM (SELECT *, row_number() OVER (PARTITION BY error IS NULL ORDER BY post_id % 2, post_id) + {base} AS n
              FROM (SELECT payload_id AS post_id, {error} AS error FROM {kind}_payloads p {more}))"""


def _post_twice(post: Callable, tables: TableSet, posts: DataFrame, column: str = "id") -> DataFrame:
    post(tables, posts.filter("post_id % 2 = 0"), writer="posts", batch=0)
    told = post(tables, posts, writer="posts", batch=1)
    return told.select("post_id", long("status").alias("status"), F.col("id").alias(column), "error")


def _payload_posts(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return V.load(spark, sf_dir, view).withColumnRenamed("payload_id", "post_id")


EVENT_ERROR = (
    "CASE WHEN payload_id % 13 IN (1, 5) THEN 'Invalid JSON body' "
    "WHEN payload_id % 13 = 2 THEN 'Invalid payload: url, headers must be an object' "
    "WHEN payload_id % 13 = 3 THEN 'Invalid payload: headers, method, timestamp, guard_action, risk_score' "
    "WHEN payload_id % 13 = 4 THEN 'Invalid payload: url, method, timestamp, guard_action, risk_score' "
    "WHEN json_extract_string(payload, '$.risk_score') = '7' THEN 'Invalid payload: risk_score' END"
)
ANALYSIS_ERRORS = {1: "Invalid event_id", 2: "Invalid rule_code", 3: "Invalid rule_score", 4: "Invalid details"}
SESSION_ERRORS = {1: "Invalid or missing start_time", 2: "Missing agent_name", 3: "Invalid environment value"}


@query(
    "i1_post_events",
    O.from_views(
        _posted("event", f"CASE WHEN s.session_id IS NULL THEN 'Session not found' ELSE {EVENT_ERROR} END", column="event_id", more="""
            JOIN guard_events e ON e.event_id = p.payload_id
            LEFT JOIN sessions s ON s.session_id = e.session_id AND p.payload_id % 17 <> 0"""),
        "event_payloads", "guard_events", "sessions",
    ),
)
def i1(spark, sf_dir):
    session = F.when(F.col("event_id") % 17 != 0, F.col("session_id"))
    of = guard_events(spark, sf_dir).select(F.col("event_id").alias("post_id"), session.alias("session_id"))
    tables = B.start(spark, scratch_path(spark, "posted"), {"sessions": sessions(spark, sf_dir)})
    return _post_twice(N.post_events, tables, _payload_posts(spark, sf_dir, "event_payloads").join(of, "post_id"), "event_id")


@query(
    "i2_post_analyses",
    O.from_views(
        _posted("analysis", f"""coalesce({_case("payload_id", ANALYSIS_ERRORS, 7)},
            CASE WHEN e.event_id IS NULL THEN 'Referenced event does not exist' END)""", column="analysis_id", more="""
            LEFT JOIN (SELECT event_id FROM guard_events WHERE guard_action <> 'Block') e ON e.event_id = p.payload_id + 1"""),
        "analysis_payloads", "guard_events",
    ),
)
def i2(spark, sf_dir):
    events = readers.with_headers(guard_events(spark, sf_dir)).filter("guard_action <> 'Block'")
    events = events.select(*[c.split()[0] for c in schemas.EVENTS.split(", ")])
    tables = B.start(spark, scratch_path(spark, "posted"), {"events": events, "rules": rules(spark)})
    return _post_twice(N.post_analyses, tables, _payload_posts(spark, sf_dir, "analysis_payloads"), "analysis_id")


@query(
    "i3_post_rules",
    O.from_views(
        """SELECT payload_id AS post_id, CASE WHEN error IS NULL THEN 201 WHEN error = 'rule_code already exists' THEN 409 ELSE 400 END::BIGINT AS status, error
           FROM (SELECT payload_id, CASE payload_id % 11 WHEN 1 THEN 'Missing weight' WHEN 2 THEN 'Invalid rule_code' WHEN 3 THEN 'Invalid weight'
                  WHEN 4 THEN 'Invalid rule_type' WHEN 5 THEN 'Invalid compute_class' WHEN 6 THEN 'Invalid is_enabled'
                  WHEN 7 THEN 'Invalid is_hard_block' WHEN 8 THEN 'Invalid description' WHEN 9 THEN 'rule_code already exists'
                  ELSE CASE WHEN row_number() OVER (PARTITION BY payload_id % 11 IN (0, 10), json_extract_string(payload, '$.rule_code') ORDER BY payload_id % 2, payload_id) > 1
                            THEN 'rule_code already exists' END END AS error FROM rule_payloads)""",
        "rule_payloads",
    ),
)
def i3(spark, sf_dir):
    tables = B.start(spark, scratch_path(spark, "posted"), {"rules": rules(spark)})
    return _post_twice(N.post_rules, tables, _payload_posts(spark, sf_dir, "rule_payloads")).drop("id")


@query(
    "i4_post_sessions",
    O.from_views(_posted("session", _case("payload_id", SESSION_ERRORS, 5), 2_000_000, column="session_id"), "session_payloads"),
)
def i4(spark, sf_dir):
    tables = B.start(spark, scratch_path(spark, "posted"), {"sessions": sessions(spark, sf_dir)}, {"sessions": 2_000_000})
    return _post_twice(N.post_sessions, tables, _payload_posts(spark, sf_dir, "session_payloads"), "session_id")


@query(
    "v1_published_mutations",
    O.from_views(
        f"""SELECT 'rule' AS kind, r.rule_code AS id, CAST(coalesce(c.is_enabled, r.is_enabled) AS VARCHAR) AS value FROM rules r LEFT JOIN changes c ON c.rule_code = r.rule_code
               WHERE r.is_hard_block OR r.rule_code IN (SELECT rule_code FROM rules_analysis)
            UNION ALL SELECT 'rule', rule_code, CAST(any_value(c.is_enabled) AS VARCHAR) FROM rules_analysis a JOIN changes c USING (rule_code)
               WHERE rule_code NOT IN (SELECT rule_code FROM rules) GROUP BY rule_code
            UNION ALL SELECT 'session', CAST(s.session_id AS VARCHAR), coalesce({O.iso_us('coalesce(s.end_time, w.end_time)')}, '') || '/' ||
               coalesce(CAST(CASE WHEN s.user_id NOT IN (SELECT user_id FROM users WHERE is_admin) THEN s.user_id END AS VARCHAR), '')
               FROM sessions s LEFT JOIN wins w ON w.session_id = s.session_id WHERE s.environment <> 'prod'
            UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), '' FROM guard_events WHERE session_id NOT IN (SELECT session_id FROM sessions WHERE environment = 'prod')
            UNION ALL SELECT 'analysis', CAST(analysis_id AS VARCHAR), '' FROM rules_analysis WHERE event_id NOT IN (SELECT event_id FROM guard_events
               WHERE session_id IN (SELECT session_id FROM sessions WHERE environment = 'prod'))""",
        "sessions", "guard_events", "rules_analysis", "users", extra=U2_X | CLOSES,
    ),
)
def v1(spark, sf_dir):
    """All mutations as versions of one set of tables, read as they are after the last one."""
    every = {
        "sessions": sessions(spark, sf_dir), "events": guard_events(spark, sf_dir), "rules_analysis": analyses(spark, sf_dir),
        "rules": rules(spark).filter("is_hard_block"), "users": V.load(spark, sf_dir, "users"),
    }
    tables = B.start(spark, scratch_path(spark, "published"), every)
    seen = tables.table("rules_analysis").select(
        F.col("rule_code").alias("rule_id"), F.lit("contextual").alias("rule_type"), F.lit(False).alias("hard_block"), F.col("details").alias("explanation")
    )
    N.register_rules(tables, K.rules_from_results(seen))
    N.enable_rules(tables, _rule_changes(spark, sf_dir))
    N.close_sessions(tables, close_requests(spark, sf_dir))
    N.delete_sessions(tables, tables.table("sessions").filter("environment = 'prod'"))
    N.delete_users(tables, tables.table("users").filter("is_admin"))
    now = tables.current()

    def shown(name: str, kind: str, key: str, value: Column) -> DataFrame:
        return tables.table(name, now).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), value.alias("value"))

    ends = F.concat(F.coalesce(iso_us("end_time"), F.lit("")), F.lit("/"), F.coalesce(F.col("user_id").cast("string"), F.lit("")))
    return (
        shown("rules", "rule", "rule_code", F.col("is_enabled").cast("string"))
        .unionByName(shown("sessions", "session", "session_id", ends))
        .unionByName(shown("events", "event", "event_id", F.lit("")))
        .unionByName(shown("rules_analysis", "analysis", "analysis_id", F.lit("")))
    )


# ------------------------------------------------------------------ the decision job
def request_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traffic as its senders would post it: some name a session, some an unknown environment."""
    page = F.col("request_id")
    env = F.when(page % 9 == 4, F.lit("dev")).otherwise(F.col("environment"))
    return V.traffic(spark, sf_dir).select(
        "request_id",
        F.to_json(F.struct(
            "url", "method", F.col("req_headers").alias("headers"), "body", env.alias("environment"), "agent_name",
            X.iso_z(F.timestamp_add("HOUR", page * 3, F.lit("2024-01-01").cast("timestamp"))).alias("timestamp"),
            F.when(page % 3 == 0, page % 40 + 20).alias("session_id"),
        )).alias("payload"),
    )


_DECIDED = {
    "posted": f"""
        SELECT r.*, p.bare, TIMESTAMP '2024-01-01 00:00:00' + r.request_id * INTERVAL '3' HOUR AS at, {O.path('r.url')} AS url_path,
               CASE WHEN r.request_id % 3 = 0 THEN r.request_id % 40 + 20 END AS explicit
        FROM reasons r JOIN pages_x p USING (request_id)""",
    "passed": f"""
        SELECT * FROM posted p
        WHERE request_id % 9 <> 4 AND NOT starts_with(user_agent, 'curl') AND method IN ('GET', 'POST')
          AND (request_id IN (SELECT request_id FROM blocked WHERE blocklisted) OR NOT (
            EXISTS (SELECT 1 FROM filter_list f WHERE f.domain <> '' AND contains(p.host, lower(f.domain)))
            OR len(list_intersect(regexp_split_to_array(host, '[._-]+'), {O.values(dims.NOISE_HOST_TOKENS)})) > 0
            OR regexp_matches(host, 'clients\\d+|gvt\\d+')
            OR len(list_filter({O.values(dims.NOISE_PATH_KEYWORDS)}, lambda k: contains(lower(url_path), k))) > 0))""",
    "open_then": """
        SELECT p.request_id, max(s.session_id) AS newest FROM passed p JOIN sessions s ON s.agent_name = p.agent_name
          AND s.environment = p.environment AND s.start_time <= p.at AND (s.end_time IS NULL OR p.at < s.end_time) GROUP BY p.request_id""",
    "attributed": f"""
        SELECT p.request_id, p.decision, p.reason, coalesce(p.explicit, o.newest) AS session_id,
               CASE WHEN p.explicit IS NULL THEN CASE WHEN o.newest IS NULL THEN {O.q(S.NO_SESSION)} END
                    WHEN s.session_id IS NULL THEN 'Provided session_id does not reference an existing session'
                    WHEN s.end_time IS NOT NULL AND p.at >= s.end_time THEN 'Provided session_id is already closed'
                    WHEN p.environment <> s.environment THEN 'Provided environment does not match the referenced session'
                    WHEN p.agent_name <> s.agent_name THEN 'Provided agent_name does not match the referenced session' END AS error
        FROM passed p LEFT JOIN sessions s ON s.session_id = p.explicit LEFT JOIN open_then o ON o.request_id = p.request_id
        UNION ALL
        SELECT request_id, NULL, NULL, NULL, {O.q("'environment' must be one of: prod, test")}
        FROM posted WHERE request_id % 9 = 4""",
    "outcomes": f"""
        SELECT request_id, CASE WHEN error IS NULL THEN session_id END AS session_id, coalesce(error, '') AS error,
               CASE WHEN error IS NULL THEN decision ELSE 'block' END AS decision, CASE WHEN error IS NULL THEN reason ELSE {O.q(E.INVALID)} END AS reason,
               CASE WHEN error IS NULL THEN 'backend' ELSE 'backend_error' END AS source,
               CAST(CASE WHEN error IS NOT NULL THEN 503 WHEN decision = 'block' THEN 403 END AS BIGINT) AS status_code
        FROM attributed""",
}
DECISION_CTES = O.scored_ctes() | REASONS | {"sessions": V.sql("sessions")} | _DECIDED


def _shown_outcome(df: DataFrame) -> DataFrame:
    return df.select(
        "request_id", "session_id", F.coalesce("error", F.lit("")).alias("error"), "decision", "reason", "source",
        long("status_code").alias("status_code"),
    )


@query("d1_decide_traffic", O.with_ctes("SELECT * FROM outcomes", "signals", DECISION_CTES))
def d1(spark, sf_dir):
    return _shown_outcome(D.decide_traffic(
        request_payloads(spark, sf_dir), sessions(spark, sf_dir), filter_list(spark, sf_dir), feed(spark, sf_dir), blocklist(spark, sf_dir)
    ))


# ------------------------------------------------------------------ X streaming
def _traffic_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.finish_traffic(V.traffic(spark, sf_dir, stream=True, max_files=2))


@query("x1_streaming_scoring", O.scoring(f"SELECT {SCORED_COLUMNS} FROM scored"))
def x1(spark, sf_dir):
    out = TableSet(spark, scratch_path(spark, "stream-scored"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        out.change(lambda now: Change(added={"scored": _scored_columns(batch)}), "scored", batch_id)

    J.score_stream(
        _traffic_stream(spark, sf_dir), sink, scratch_path(spark, "checkpoint"), feed(spark, sf_dir), blocklist(spark, sf_dir)
    ).awaitTermination()
    return out.table("scored")


@query(
    "x2_streaming_audit",
    O.scoring(
        """SELECT l.request_id * 100 + l.ordinal AS analysis_id, l.request_id AS event_id, l.rule_id AS rule_code, l.score AS rule_score,
                  l.explanation AS details, upper(s.decision[1]) || s.decision[2:] AS guard_action
           FROM long l JOIN scored s USING (request_id)"""
    ),
)
def x2(spark, sf_dir):
    out = scratch_path(spark, "stream-audit")
    J.write_stream(
        _traffic_stream(spark, sf_dir), out, scratch_path(spark, "checkpoint"),
        feed=feed(spark, sf_dir), blocklist=blocklist(spark, sf_dir),
    ).awaitTermination()
    events = J.read_audit(spark, out, "events").select("event_id", "guard_action")
    return J.read_audit(spark, out, "rules_analysis").join(events, "event_id")


CLOSED_SQL = O.from_views(
    f"""SELECT session_id, {O.iso_us('start_time')} AS start_time, {O.iso_us('end_time')} AS end_time, environment, agent_name,
               CASE next_action WHEN 'start' THEN {O.q(S.SUPERSEDED)} WHEN 'stop' THEN {O.q(S.STOPPED)} END AS end_reason,
               replaced_session_id
        FROM rotated WHERE end_time IS NOT NULL""",
    "lifecycle", extra=ROTATED,
)


def _shown_sessions(df: DataFrame) -> DataFrame:
    return df.withColumns({"start_time": iso_us("start_time"), "end_time": iso_us("end_time")}).select(
        "session_id", "start_time", "end_time", "environment", "agent_name", "end_reason", "replaced_session_id"
    )


#: The files of the given table are in no order of time; all of it spans a month.
LATENESS_SECONDS = 40 * 86_400


@query("x3_stateful_rotation", CLOSED_SQL)
def x3(spark, sf_dir):
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, J.ROCKSDB)
    try:
        out = scratch_path(spark, "stream-sessions")
        # all files in one batch: moves far beyond all others, of an agent of its own, make the watermark pass
        # the last ones when it ends, and would make later batches late
        moves = V.load(spark, sf_dir, "lifecycle", stream=True)
        clock = F.when(F.col("action") == "start", F.col("ts") + F.expr("INTERVAL 1000 DAY"))
        ticks = moves.select("event_id", clock.alias("ts"), F.lit("start").alias("action"), "environment", F.lit("clock").alias("agent_name"))
        closed = J.session_stream(moves.unionByName(ticks), f"{LATENESS_SECONDS} seconds").filter("agent_name <> 'clock'")
        (
            closed.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", scratch_path(spark, "checkpoint"))
            .trigger(availableNow=True).start().awaitTermination()
        )
    finally:
        spark.conf.set(setting, before)
    return _shown_sessions(spark.read.parquet(out))


@query("x3_rotation_in_batches", CLOSED_SQL)
def x3_batches(spark, sf_dir):
    out = scratch_path(spark, "stream-rotation")
    moves = V.load(spark, sf_dir, "lifecycle", stream=True, max_files=4)
    J.rotate_stream(moves, out, scratch_path(spark, "checkpoint"), LATENESS_SECONDS).awaitTermination()
    return _shown_sessions(J.settle_rotation(spark, out).table("closed"))


@query("x4_streaming_stats", O.from_views(STATS_SQL, "sessions", "guard_events"))
def x4(spark, sf_dir):
    rows = V.load(spark, sf_dir, "guard_events", stream=True, max_files=1)
    out = scratch_path(spark, "stream-stats")
    J.publish_stats(rows.select("event_id", "session_id", "guard_action", "risk_score"), out, scratch_path(spark, "checkpoint")).awaitTermination()
    return (
        sessions(spark, sf_dir).select("session_id").join(J.read_stats(spark, out), "session_id", "left")
        .fillna(0, ["total_events", "allow", "warn", "block"]).fillna(0.0, ["average_risk_score"])
        .withColumn("average_risk_score", F.round("average_risk_score", 12))
    )


# ------------------------------------------------------------------ flagship
FLAGSHIP_SQL = O.scoring(
    """SELECT host, decision, count(*) AS requests, round(avg(risk_score), 12) AS average_risk,
              count(*) FILTER (WHERE hard_block_triggered) AS hard_blocks FROM scored GROUP BY host, decision"""
)


@query("host_decisions", FLAGSHIP_SQL)
def flagship(spark, sf_dir):
    """Traffic to decisions: requests, mean risk and hard blocks per host and decision."""
    return (
        scored(spark, sf_dir)
        .groupBy("host", "decision")
        .agg(
            F.count("*").alias("requests"),
            F.round(F.avg("risk_score"), 12).alias("average_risk"),
            F.count_if("hard_block_triggered").alias("hard_blocks"),
        )
    )
