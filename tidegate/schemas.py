"""Explicit schemas of every table the jobs read or write."""

from __future__ import annotations

TRAFFIC = (
    "request_id long, timestamp timestamp, method string, url string, req_headers map<string,string>, "
    "body string, environment string, agent_name string, session_id long, status_code int, "
    "resp_headers map<string,string>, resp_body string"
)
SESSIONS = (
    "session_id long, user_id long, start_time timestamp, end_time timestamp, "
    "environment string, agent_name string"
)
LIFECYCLE = "event_id long, ts timestamp, action string, environment string, agent_name string"
EVENTS = (
    "event_id long, session_id long, timestamp timestamp, url string, guard_action string, "
    "risk_score double, http_method string, headers map<string,string>"
)
RULES = (
    "rule_code string, weight double, rule_type string, compute_class string, "
    "is_enabled boolean, is_hard_block boolean, description string"
)
RULES_ANALYSIS = (
    "analysis_id long, event_id long, rule_code string, rule_score double, details string"
)
USERS = "user_id long, username string, is_admin boolean"
THREAT_FEED = "domain string, source string, listed boolean, observed_at timestamp"
BRAND_DOMAINS = "brand string, brand_ord int, domain string, domain_ord int, label string"
RULE_REGISTRY = (
    "rule_id string, ordinal int, description string, rule_type string, compute_class string, "
    "weight double, hard_block boolean"
)
RULE_RESULT = (
    "struct<ordinal:int,rule_id:string,rule_type:string,score:double,hard_block:boolean,"
    "explanation:string,triggered:boolean>"
)
