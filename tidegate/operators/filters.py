"""Traffic and listing filters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import text as X
from tidegate.functions import urls as U
from tidegate.sources import dims


def _any_of(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def is_browser_ua(ua: Column) -> Column:
    """F1."""
    lowered = F.lower(F.coalesce(ua, F.lit("")))
    return ~F.contains(lowered, F.lit("electron/")) & lowered.rlike(_any_of(dims.BROWSER_MARKERS))


def is_enforced_method(method: Column) -> Column:
    """F2."""
    return F.upper(method).isin(dims.ENFORCED_METHODS)


is_action_request = is_enforced_method


def is_static_resource(url: Column) -> Column:
    """F3."""
    path = F.lower(U.path(url))
    return path.isin(dims.STATIC_PATHS) | path.rlike(rf"(?:{_any_of(dims.STATIC_SUFFIXES)})$")


def is_sec_fetch_subresource(headers: Column) -> Column:
    """F4."""
    return F.lower(X.header(headers, "sec-fetch-dest")).isin(dims.SEC_FETCH_SUBRESOURCES)


def is_binary_media(resp_headers: Column) -> Column:
    """F5."""
    return F.lower(X.header(resp_headers, "content-type")).rlike("^(?:image|font|video|audio)/")


def is_upgrade(headers: Column) -> Column:
    """F6."""
    return F.contains(F.lower(X.header(headers, "connection")), F.lit("upgrade")) | (
        F.lower(X.header(headers, "upgrade")) == "websocket"
    )


def host_has_noise_token(host: Column) -> Column:
    """F7."""
    tokens = F.array(*[F.lit(t) for t in dims.NOISE_HOST_TOKENS])
    return F.arrays_overlap(U.host_tokens(host), tokens) | F.lower(host).rlike(r"clients\d+|gvt\d+")


def has_noise_path(url: Column) -> Column:
    return F.lower(U.path(url)).rlike(_any_of(dims.NOISE_PATH_KEYWORDS))


def is_noise(
    url: Column, headers: Column, host_listed: Column
) -> Column:
    """F9; `host_listed` says whether the host is on the filter list (F8)."""
    host = U.host(url)
    return (
        host_has_noise_token(host)
        | host_listed
        | is_upgrade(headers)
        | has_noise_path(url)
        | (X.header(headers, "report-to") != "")
        | (X.header(headers, "nel") != "")
    )


def should_forward(
    url: Column, method: Column, headers: Column, host_listed: Column, blocklisted: Column
) -> Column:
    """a custom blocklist match wins over noise."""
    return (
        is_browser_ua(X.header(headers, "user-agent"))
        & is_enforced_method(method)
        & (blocklisted | ~is_noise(url, headers, host_listed))
    )


def is_subresource(url: Column, headers: Column) -> Column:
    return is_static_resource(url) | is_sec_fetch_subresource(headers)


def should_ignore_response(
    url: Column,
    method: Column,
    headers: Column,
    status: Column,
    resp_headers: Column,
    resp_body: Column,
    host_listed: Column,
) -> Column:
    """F11."""
    success = F.coalesce(status.between(200, 299), F.lit(False))
    empty = F.coalesce(F.octet_length(resp_body), F.lit(0)) == 0
    return (
        ~success
        | is_subresource(url, headers)
        | is_binary_media(resp_headers)
        | ~is_browser_ua(X.header(headers, "user-agent"))
        | is_noise(url, headers, host_listed)
        | F.when(is_enforced_method(method), empty).otherwise(F.upper(method) != "GET")
    )


def should_log_request(url: Column, headers: Column) -> Column:
    """F12 for requests."""
    return ~is_subresource(url, headers)


def should_log_response(url: Column, headers: Column, status: Column, resp_headers: Column) -> Column:
    """F12 for responses."""
    return status.isNotNull() & ~(is_subresource(url, headers) | is_binary_media(resp_headers))


def _timestamp(value) -> Column:
    return F.lit(value) if isinstance(value, datetime) else X.parse_iso(F.lit(value))


def check_event_filters(
    guard_action: str | None = None,
    min_risk: float | None = None,
    max_risk: float | None = None,
    from_ts=None,
    to_ts=None,
) -> None:
    """Q7: reject contradictory or ill-typed filter arguments."""
    if guard_action is not None and guard_action not in dims.GUARD_ACTIONS:
        raise ValueError("Invalid guard_action")
    for bound in (min_risk, max_risk):
        if bound is None:
            continue
        try:
            number = float(bound)
        except (TypeError, ValueError):
            raise ValueError("Invalid query parameters") from None
        if not 0 <= number <= 1:
            raise ValueError("Invalid query parameters")
    if min_risk is not None and max_risk is not None and float(min_risk) > float(max_risk):
        raise ValueError("Invalid query parameters")
    start, end = (_checked_time(v, n) for v, n in ((from_ts, "from"), (to_ts, "to")))
    if start is not None and end is not None and start > end:
        raise ValueError("Invalid query parameters")


def _checked_time(value, name: str) -> datetime | None:
    if value is None:
        return None
    from datetime import timezone

    try:
        moment = value if isinstance(value, datetime) else datetime.fromisoformat(str(value).strip())
    except ValueError:
        raise ValueError(f"Invalid {name}_timestamp") from None
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def filter_events(
    events: DataFrame,
    session_id: int | None = None,
    guard_action: str | None = None,
    min_risk: float | None = None,
    max_risk: float | None = None,
    from_ts=None,
    to_ts=None,
) -> DataFrame:
    """all bounds are inclusive and a missing one is skipped; predicates reach the scan."""
    check_event_filters(guard_action, min_risk, max_risk, from_ts, to_ts)
    out = events
    if session_id is not None:
        out = out.filter(F.col("session_id") == session_id)
    if guard_action:
        out = out.filter(F.col("guard_action") == guard_action)
    if min_risk is not None:
        out = out.filter(F.col("risk_score") >= float(min_risk))
    if max_risk is not None:
        out = out.filter(F.col("risk_score") <= float(max_risk))
    start, end = _checked_time(from_ts, "from"), _checked_time(to_ts, "to")
    if start is not None:
        out = out.filter(F.col("timestamp") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("timestamp") <= F.lit(end))
    return out


def search_sessions(sessions: DataFrame, term: str) -> DataFrame:
    """case-insensitive substring of agent, session id or user id; blank keeps all."""
    q = term.strip().lower()
    if not q:
        return sessions
    return sessions.filter(
        F.contains(F.lower(F.coalesce("agent_name", F.lit(""))), F.lit(q))
        | F.contains(F.col("session_id").cast("string"), F.lit(q))
        | F.coalesce(F.contains(F.col("user_id").cast("string"), F.lit(q)), F.lit(False))
    )


def search_rules(
    rules: DataFrame,
    term: str = "",
    rule_type: str | None = None,
    compute_class: str | None = None,
    hard_block: bool | None = None,
    enabled: bool | None = None,
) -> DataFrame:
    """substring of code or description, and exact facets."""
    out, q = rules, term.strip().lower()
    if q:
        out = out.filter(
            F.contains(F.lower("rule_code"), F.lit(q))
            | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(q))
        )
    for name, value in (
        ("rule_type", rule_type or None),
        ("compute_class", compute_class or None),
        ("is_hard_block", hard_block),
        ("is_enabled", enabled),
    ):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out
