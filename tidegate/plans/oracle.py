"""Oracles: the same results as plain SQL, written for DuckDB.

They use relational forms on purpose (windows over tag rows, range joins), so that they share
nothing with the jobs they check but the input views and the fixed tables.
"""

from __future__ import annotations

import html.entities

from tidegate.operators import enforcement as E
from tidegate.operators import rules as R
from tidegate.operators import sessions as S
from tidegate.plans import views
from tidegate.sources import dims

WS = " \t\n\r\x0b\x0c\xa0"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


def iso_us(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f')"


# ------------------------------------------------------------------ URL snippets
def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1))"


def authority(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"


def host(u: str) -> str:
    return f"lower(regexp_replace(regexp_replace({authority(u)}, '^.*@', ''), ':[0-9]*$', ''))"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def strip_www(h: str) -> str:
    return f"regexp_replace(lower({h}), '^www\\.', '')"


def is_ip(h: str) -> str:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return f"regexp_full_match({h}, '{octet}(\\.{octet}){{3}}')"


def suffixes(h: str) -> str:
    parts = f"string_split({h}, '.')"
    return f"list_transform(range(1, len({parts}) + 1), lambda i: array_to_string({parts}[i:], '.'))"


#: The entries of the list in use for the top-level labels that the given pages have; none of them is a wildcard.
PAGE_SUFFIXES = [s for s in dims.suffix_list().entries if s.rsplit(".", 1)[-1] in ("com", "net", "org") and not s.startswith(("*", "!"))]


def label(h: str) -> str:
    parts = f"string_split({h}, '.')"
    known = values(PAGE_SUFFIXES)
    place = f"list_position(list_transform({suffixes(h)}, lambda s: list_contains({known}, s)), true)"
    return f"{parts}[greatest(coalesce(nullif({place}, 0), len({parts})) - 1, 1)]"


def normalize(h: str) -> str:
    text = f"lower({h})"
    for a, b in dims.MULTI_CHAR_CONFUSABLES:
        text = f"replace({text}, {q(a)}, {q(b)})"
    src = "".join(a for a, _ in dims.CHAR_CONFUSABLES)
    dst = "".join(b for _, b in dims.CHAR_CONFUSABLES)
    return f"translate({text}, {q(src)}, {q(dst)})"


def header_blank(c: str) -> str:
    return f"coalesce({c}, '')"


def decode(text: str) -> str:
    """Character references of page text (those the test pages hold are all complete)."""
    table = {**{n: chr(c) for n, c in html.entities.name2codepoint.items()}, "apos": "'"}
    keys, vals = values(table), values(table.values())
    piece = (
        "CASE WHEN regexp_extract(p, '^([a-zA-Z][a-zA-Z0-9]*);?', 1) <> '' AND "
        f"list_contains({keys}, regexp_extract(p, '^([a-zA-Z][a-zA-Z0-9]*);?', 1)) "
        f"THEN {vals}[list_position({keys}, regexp_extract(p, '^([a-zA-Z][a-zA-Z0-9]*);?', 1))] "
        "|| regexp_replace(p, '^[a-zA-Z][a-zA-Z0-9]*;?', '') "
        "WHEN regexp_matches(p, '^[a-zA-Z]') THEN '&' || regexp_replace(p, '^([a-zA-Z][a-zA-Z0-9]*);?', '\\1') "
        "ELSE '&' || p END"
    )
    parts = f"string_split({text}, '&')"
    return (
        f"CASE WHEN contains({text}, '&') THEN {parts}[1] || "
        f"array_to_string(list_transform({parts}[2:], lambda p: {piece}), '') ELSE {text} END"
    )


# ------------------------------------------------------------------ page CTEs
TAG = """</?[a-zA-Z](?:[^'">]|"[^"]*"|'[^']*')*>"""
INERT = r"<!--.*?-->|(<script\b[^>]*>).*?</script\s*>|(<style\b[^>]*>).*?</style\s*>"
MARKUP = TAG + "|<[!?][^>]*>"
MARK = "\x01"


def attr(raw: str, name: str) -> str:
    """Attribute value, null when absent."""
    pattern = f"""[\\s"'/]{name}\\s*=\\s*("[^"]*"|'[^']*'|[^\\s>"']+)"""
    found = f"regexp_extract_all({raw}, {q(pattern)}, 1, 'i')"
    last = f"list_extract({found}, -1)"
    return f"""CASE WHEN len({found}) = 0 THEN NULL ELSE trim({last}, {q(chr(34) + chr(39))}) END"""


def joined(base: str, ref: str) -> str:
    """A reference against a base (absolute, `//host`, `/path` and plain relative ones)."""
    site = f"regexp_extract({base}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', 0)"
    folder = f"regexp_extract({base}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*/|/)?', 0)"
    return (
        f"CASE WHEN {ref} = '' THEN {base} WHEN regexp_matches({ref}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {ref} "
        f"WHEN starts_with({ref}, '//') THEN {scheme(base)} || ':' || {ref} "
        f"WHEN starts_with({ref}, '/') THEN {site} || {ref} "
        f"WHEN starts_with({ref}, '#') THEN regexp_replace({base}, '#.*$', '') || {ref} "
        f"ELSE {folder} || {ref} END"
    )


SENSITIVE = dims.SENSITIVE_NAME_PATTERN

_VIEW_CTES = {name: views.sql(name) for name in views.VIEWS}

_CTES = {
    "weblog": _VIEW_CTES["weblog"],
    "weblog_x": f"SELECT *, {host('url')} AS host, lower(regexp_replace({path('url')}, ';[^/]*$', '')) AS path FROM weblog",
    "blocklist": f"""
        SELECT DISTINCT lower(trim(split_part(value, '#', 1), {q(WS)})) AS entry
        FROM ({_VIEW_CTES['blocklist_lines']}) WHERE trim(split_part(value, '#', 1), {q(WS)}) <> ''""",
    "block_rules": f"""
        SELECT entry, kind,
               CASE WHEN kind = 'host' THEN {strip_www("CASE WHEN contains(entry, '://') THEN " + host('entry') + " ELSE trim(entry, '.') END")} END AS rule_host,
               CASE WHEN kind = 'url' THEN rtrim(split_part(entry, '?', 1), '/') END AS url_base,
               CASE WHEN kind = 'url' AND contains(entry, '?') THEN substr(entry, strpos(entry, '?') + 1) END AS query
        FROM (SELECT entry, CASE WHEN contains(entry, '://')
                     THEN CASE WHEN trim({path('entry')}, '/') = '' AND NOT contains(entry, '?') THEN 'host' ELSE 'url' END
                     WHEN contains(entry, '/') OR contains(entry, '?') THEN 'url' ELSE 'host' END AS kind FROM blocklist)""",
    "filter_list": f"""
        SELECT DISTINCT replace(split_part(trim(value, {q(WS)}), '^', 1), '||', '') AS domain
        FROM ({_VIEW_CTES['filter_lines']})
        WHERE starts_with(trim(value, {q(WS)}), '||') AND contains(value, '^')""",
    "feed": _VIEW_CTES["threat_feed"],
    "weblog_flags": f"""
        SELECT w.*,
          EXISTS (SELECT 1 FROM filter_list f WHERE f.domain <> '' AND contains(w.host, lower(f.domain))) AS host_listed,
          EXISTS (SELECT 1 FROM block_rules b WHERE (b.kind = 'host' AND b.rule_host <> ''
                    AND ({strip_www('w.host')} = b.rule_host OR ends_with({strip_www('w.host')}, '.' || b.rule_host)))
               OR (b.kind = 'url' AND rtrim(split_part(lower(w.url), '?', 1), '/') = b.url_base
                    AND (b.query IS NULL OR (contains(w.url, '?') AND substr(lower(w.url), strpos(w.url, '?') + 1) = b.query)))) AS blocklisted,
          regexp_matches(lower(user_agent), 'chrome/|firefox/|safari/|edg/') AND NOT contains(lower(user_agent), 'electron/') AS browser,
          upper(method) IN ('GET', 'POST', 'PUT', 'PATCH', 'DELETE') AS enforced,
          path IN ('/favicon.ico', '/robots.txt') OR regexp_matches(path, '({"|".join("[.]" + s[1:] for s in dims.STATIC_SUFFIXES)})$') AS static,
          list_contains({values(dims.SEC_FETCH_SUBRESOURCES)}, lower(fetch_dest)) AS sec_fetch,
          regexp_matches(lower(resp_type), '^(image|font|video|audio)/') AS media,
          contains(lower(connection), 'upgrade') OR lower(upgrade_to) = 'websocket' AS upgrade,
          len(list_intersect(regexp_split_to_array(host, '[._-]+'), {values(dims.NOISE_HOST_TOKENS)})) > 0
            OR regexp_matches(host, 'clients\\d+|gvt\\d+') AS noise_token,
          len(list_filter({values(dims.NOISE_PATH_KEYWORDS)}, lambda k: contains(path, k))) > 0 AS noise_path,
          report_to <> '' AS reporting
        FROM weblog_x w""",
    "weblog_verdicts": """
        SELECT *, noise_token OR host_listed OR upgrade OR noise_path OR reporting AS noise,
               browser AND enforced AND (blocklisted OR NOT (noise_token OR host_listed OR upgrade OR noise_path OR reporting)) AS forward,
               status_code NOT BETWEEN 200 AND 299 OR static OR sec_fetch OR media OR NOT browser
                 OR noise_token OR host_listed OR upgrade OR noise_path OR reporting
                 OR CASE WHEN enforced THEN length(resp_body) = 0 ELSE upper(method) <> 'GET' END AS ignored
        FROM weblog_flags""",
    "traffic": _VIEW_CTES["traffic"],
    "pages_x": f"""
        SELECT request_id, url, html, {scheme('url')} AS scheme, {host('url')} AS host, {strip_www(host('url'))} AS bare,
               method, status_code, ts, environment, agent_name, content_type, user_agent,
               contains(lower(content_type), 'text/html') AS is_html
        FROM traffic""",
    # `live` removes comments and the bodies of scripts and styles, for every page.
    "live": f"""
        SELECT request_id, url, host, scheme, html, is_html,
               regexp_replace(html, {q(INERT)}, '<!>\\1\\2', 'gis') AS live FROM pages_x""",
    "tags": f"""
        SELECT request_id, url, host, unnest(found) AS raw, generate_subscripts(found, 1) AS pos
        FROM (SELECT request_id, url, host, regexp_extract_all(live, {q(TAG)}) AS found FROM live)""",
    "tag_names": """
        SELECT *, lower(regexp_extract(raw, '^</?([a-zA-Z][^\\s/>]*)', 1)) AS tag, starts_with(raw, '</') AS closing FROM tags""",
    "titles": f"""
        SELECT request_id, trim({decode("t")}, {q(WS)}) AS title
        FROM (SELECT request_id, regexp_extract(live, '<title\\b[^>]*>(.*?)</title\\s*>', 1, 'is') AS t FROM live)""",
    "texts": f"""
        SELECT request_id, array_to_string(list_filter(list_transform(
                 string_split(regexp_replace(live, {q(MARKUP)}, {q(MARK)}, 'g'), {q(MARK)}),
                 lambda n: trim({decode("n")}, {q(WS)})), lambda n: n <> ''), ' ') AS text
        FROM live""",
    "form_tags": """
        SELECT *, sum(CASE WHEN tag = 'form' AND NOT closing THEN 1 ELSE 0 END) OVER w AS opens,
                  sum(CASE WHEN tag = 'form' AND closing THEN 1 ELSE 0 END) OVER w AS closes
        FROM tag_names WHERE tag IN ('form', 'input')
        WINDOW w AS (PARTITION BY request_id ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
    "forms": f"""
        SELECT request_id, CAST(opens AS BIGINT) AS form_no, coalesce({attr('raw', 'action')}, '') AS action,
               lower(coalesce({attr('raw', 'method')}, 'get')) AS method,
               {host(joined('url', f"coalesce({attr('raw', 'action')}, '')"))} AS action_host
        FROM form_tags WHERE tag = 'form' AND NOT closing""",
    "inputs": f"""
        SELECT request_id, CASE WHEN opens > closes THEN CAST(opens AS BIGINT) END AS form_no,
               row_number() OVER (PARTITION BY request_id ORDER BY pos) AS input_no,
               lower(coalesce({attr('raw', 'type')}, 'text')) AS type,
               coalesce({attr('raw', 'name')}, '') AS name, coalesce({attr('raw', 'id')}, '') AS id
        FROM form_tags WHERE tag = 'input' AND NOT closing""",
    "hot_inputs": f"""
        SELECT * FROM inputs WHERE type = 'password' OR regexp_matches(name || ' ' || id, {q(SENSITIVE)}, 'i')""",
    "links": f"""
        SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS link_no, {joined('url', 'href')} AS link
        FROM (SELECT request_id, url, pos, {attr('raw', 'href')} AS href FROM tag_names WHERE tag = 'a' AND NOT closing)
        WHERE href IS NOT NULL""",
    "scripts": f"""
        SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS script_no, {joined('url', 'src')} AS script
        FROM (SELECT request_id, url, pos, {attr('raw', 'src')} AS src FROM tag_names WHERE tag = 'script' AND NOT closing)
        WHERE src IS NOT NULL""",
    "meta": f"""
        SELECT request_id, name, arg_max(content, pos) AS content FROM (
          SELECT request_id, pos, lower(coalesce(nullif({attr('raw', 'name')}, ''), {attr('raw', 'http-equiv')}, '')) AS name,
                 coalesce({attr('raw', 'content')}, '') AS content
          FROM tag_names WHERE tag = 'meta' AND NOT closing) WHERE name <> '' GROUP BY request_id, name""",
    # ---------------------------------------------------------------- matching
    "hosts": "SELECT DISTINCT host, bare FROM pages_x",
    "listed": """
        SELECT lower(domain) AS candidate, arg_min(source, CASE source WHEN 'PhishTank' THEN 1 WHEN 'URLhaus' THEN 2 ELSE 3 END) AS source
        FROM feed WHERE listed GROUP BY lower(domain)""",
    "feed_hits": """
        SELECT h.host, arg_max(l.candidate, length(l.candidate)) AS candidate, arg_max(l.source, length(l.candidate)) AS source
        FROM hosts h JOIN listed l ON (h.bare = l.candidate OR ends_with(h.bare, '.' || l.candidate)) AND contains(l.candidate, '.')
        GROUP BY h.host""",
    "block_hosts": """
        SELECT DISTINCT h.host FROM hosts h JOIN block_rules b
        ON b.kind = 'host' AND b.rule_host <> '' AND (h.bare = b.rule_host OR ends_with(h.bare, '.' || b.rule_host))""",
    "blocked": """
        SELECT p.request_id,
               p.host IN (SELECT host FROM block_hosts)
               OR EXISTS (SELECT 1 FROM block_rules b WHERE b.kind = 'url'
                    AND rtrim(split_part(lower(p.url), '?', 1), '/') = b.url_base
                    AND (b.query IS NULL OR (contains(p.url, '?') AND substr(lower(p.url), strpos(p.url, '?') + 1) = b.query))) AS blocklisted
        FROM pages_x p""",
    "brands": "SELECT * FROM (VALUES "
    + ", ".join(f"({q(b)}, {bo}, {q(d)}, {do}, {q(lb)})" for b, bo, d, do, lb in dims.brand_rows())
    + ") AS t(brand, brand_ord, domain, domain_ord, label)",
    "brand_hits": """
        SELECT p.request_id, arg_min(b.brand, b.brand_ord) AS brand
        FROM pages_x p JOIN titles t USING (request_id)
        JOIN (SELECT brand, brand_ord FROM brands GROUP BY ALL) b ON contains(lower(t.title), b.brand)
        WHERE p.is_html AND NOT EXISTS (SELECT 1 FROM brands d WHERE d.brand = b.brand AND (p.bare = d.domain OR ends_with(p.bare, '.' || d.domain)))
        GROUP BY p.request_id""",
    "labels_x": f"SELECT host, bare, {label('bare')} AS own, {label(normalize('bare'))} AS plain FROM hosts",
    "typo_pairs": """
        SELECT l.host, b.brand_ord * 100 + b.domain_ord AS ord, b.domain,
               CASE WHEN l.plain = b.label AND l.own <> b.label THEN 'confusable'
                    WHEN l.plain <> b.label AND length(l.plain) >= 3 AND length(b.label) >= 3 AND abs(length(l.plain) - length(b.label)) <= 2
                         AND (levenshtein(l.plain, b.label) = 1 OR (levenshtein(l.plain, b.label) = 2
                              AND l.plain[1] = b.label[1] AND l.plain[-1] = b.label[-1])) THEN 'typosquat' END AS kind
        FROM labels_x l, brands b
        WHERE NOT """ + is_ip("l.bare") + """ AND NOT (l.own = l.plain AND l.plain IN (SELECT label FROM brands))""",
    "typo_hits": """
        SELECT host, arg_min(kind, ord) AS kind, arg_min(domain, ord) AS official FROM typo_pairs WHERE kind IS NOT NULL GROUP BY host""",
    "redirects": "SELECT request_id, arg_min(vector, p * 1000000 + i) AS vector, arg_min(target, p * 1000000 + i) AS target FROM ("
    + " UNION ALL ".join(
        f"SELECT request_id, bare, {n} AS p, i, {q(vector)} AS vector, {host('trim(m)')} AS target FROM ("
        f"SELECT request_id, bare, unnest(f) AS m, generate_subscripts(f, 1) AS i FROM ("
        f"SELECT request_id, bare, regexp_extract_all(html, {q(pattern)}, 1, 'i') AS f FROM pages_x))"
        for n, (pattern, vector) in enumerate(dims.REDIRECT_PATTERNS)
    )
    + f") WHERE target <> '' AND {strip_www('target')} <> bare GROUP BY request_id",
    "form_hits": f"""
        SELECT f.request_id, arg_min(f.action_host, f.form_no) AS action_host
        FROM forms f JOIN pages_x p USING (request_id)
        WHERE f.action_host <> '' AND {strip_www('f.action_host')} <> p.bare
          AND EXISTS (SELECT 1 FROM hot_inputs i WHERE i.request_id = f.request_id AND i.form_no = f.form_no)
        GROUP BY f.request_id""",
    "signals": """
        SELECT p.*, f.candidate, f.source, p.scheme <> 'https' AND p.host NOT IN ('localhost', '127.0.0.1') AS plain_http,
               p.is_html AND p.request_id IN (SELECT request_id FROM hot_inputs) AS sensitive,
               CASE WHEN p.is_html THEN b.brand END AS brand, r.vector, r.target, CASE WHEN p.is_html THEN fo.action_host END AS action_host,
               t.kind, t.official, """ + is_ip("p.host") + """ AS ip, k.blocklisted, l.own, l.plain
        FROM pages_x p LEFT JOIN feed_hits f ON f.host = p.host LEFT JOIN brand_hits b ON b.request_id = p.request_id
        LEFT JOIN redirects r ON r.request_id = p.request_id LEFT JOIN form_hits fo ON fo.request_id = p.request_id
        LEFT JOIN typo_hits t ON t.host = p.host LEFT JOIN blocked k ON k.request_id = p.request_id
        LEFT JOIN labels_x l ON l.host = p.host""",
}


def _verdict_sql() -> dict[str, tuple[str, str]]:
    """Per rule: (hit, explanation)."""
    return {
        "domain_blacklist": (
            "candidate IS NOT NULL",
            "CASE WHEN candidate IS NOT NULL THEN 'Domain ''' || candidate || ''' found in ' || source || ' threat database' ELSE 'Domain not found in threat database' END",
        ),
        "unencrypted_connection": (
            "plain_http",
            "CASE WHEN plain_http THEN 'Connection is unencrypted (''' || scheme || '://'')' WHEN scheme = 'https' THEN 'Connection is encrypted (HTTPS)' ELSE 'Local loopback; HTTP is acceptable for local development' END",
        ),
        "sensitive_fields": (
            "sensitive",
            "CASE WHEN sensitive THEN 'Page contains input fields associated with credential or secret collection' ELSE 'No sensitive input fields detected' END",
        ),
        "brand_domain_mismatch": (
            "brand IS NOT NULL",
            "CASE WHEN brand IS NOT NULL THEN 'Page title references brand ''' || brand || ''' but is hosted on non-official domain ''' || bare || '''' WHEN is_html THEN 'No brand-domain mismatch detected' ELSE 'No DOM content to inspect' END",
        ),
        "unexpected_redirect": (
            "sensitive AND vector IS NOT NULL",
            "CASE WHEN sensitive AND vector IS NOT NULL THEN vector || ' redirects to external domain ''' || target || ''' during a sensitive interaction' WHEN sensitive THEN 'No unexpected external redirect detected during sensitive interaction' ELSE 'No sensitive interaction context to evaluate' END",
        ),
        "external_form_action": (
            "action_host IS NOT NULL",
            "CASE WHEN action_host IS NOT NULL THEN 'A form with sensitive fields submits to external domain ''' || action_host || '''' WHEN is_html THEN 'No external form action with sensitive fields detected' ELSE 'No DOM content to inspect' END",
        ),
        "typosquatting": (
            "kind IS NOT NULL",
            "CASE WHEN kind = 'confusable' THEN 'Domain ''' || bare || ''' uses confusable characters to impersonate ''' || official || '''' WHEN kind = 'typosquat' THEN 'Domain ''' || bare || ''' appears to be a typosquat of ''' || official || '''' WHEN ip THEN 'IP address — typosquatting check not applicable' WHEN own = plain AND plain IN (SELECT label FROM brands) THEN 'Domain label is a known official brand (not a typosquat of another brand)' ELSE 'No typosquatting pattern detected' END",
        ),
        "ip_based_url": (
            "ip",
            "CASE WHEN ip THEN 'Page accessed via raw IP address ''' || host || '''' ELSE 'Page uses a registered domain name' END",
        ),
        "custom_blacklist": (
            "blocklisted",
            "CASE WHEN blocklisted THEN 'URL ''' || url || ''' matches the custom local blacklist' ELSE 'Not found in custom local blacklist' END",
        ),
    }


SOFT = ["sensitive_fields", "brand_domain_mismatch", "unexpected_redirect", "external_form_action"]


def scored_ctes(enabled: list[str] | None = None) -> dict[str, str]:
    """CTEs `long` (event, rule) and `scored` (event) for a set of enabled rules."""
    verdicts = _verdict_sql()
    rows = []
    for i, rule in enumerate(dims.RULE_REGISTRY, start=1):
        hit, why = verdicts[rule.rule_id]
        on = "TRUE" if enabled is None or rule.rule_id in enabled else "FALSE"
        rows.append(
            f"SELECT request_id, {i} AS ordinal, {q(rule.rule_id)} AS rule_id, {str(rule.hard_block).upper()} AS hard_block, "
            f"CAST({rule.weight} AS DOUBLE) AS weight, {on} AS enabled, coalesce({hit}, FALSE) AS hit, {why} AS why FROM signals"
        )
    return {
        "every": " UNION ALL ".join(rows),
        "hard": "SELECT request_id, min(ordinal) AS first_hard FROM every WHERE enabled AND hard_block AND hit GROUP BY request_id",
        "long": f"""
            SELECT e.request_id, e.ordinal, e.rule_id, e.hard_block, e.weight, coalesce(e.ordinal > h.first_hard, FALSE) AS skipped,
                   CASE WHEN coalesce(e.ordinal > h.first_hard, FALSE) THEN NULL WHEN e.hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
                   CASE WHEN e.ordinal > h.first_hard THEN {q(R.SKIPPED)} ELSE e.why END AS explanation,
                   e.hit AND NOT coalesce(e.ordinal > h.first_hard, FALSE) AS triggered
            FROM every e LEFT JOIN hard h USING (request_id)
            WHERE e.enabled OR coalesce(e.ordinal > h.first_hard, FALSE)""",
        "raw_scores": """
            SELECT request_id, sum(score * weight ORDER BY ordinal) / sum(weight ORDER BY ordinal) AS raw,
                   count(*) AS rule_count, count(*) FILTER (WHERE triggered) AS triggered_rule_count
            FROM long GROUP BY request_id""",
        "scored": """
            SELECT p.request_id, p.url, p.host, p.method, p.scheme, p.ts, p.environment, p.agent_name, p.content_type, p.user_agent,
                   h.first_hard IS NOT NULL AS hard_block_triggered,
                   CASE WHEN h.first_hard IS NOT NULL THEN 'block' WHEN s.raw >= 0.7 THEN 'block' WHEN s.raw >= 0.4 THEN 'warn' ELSE 'allow' END AS decision,
                   CASE WHEN h.first_hard IS NOT NULL THEN 1.0::DOUBLE ELSE round(coalesce(s.raw, 0.0), 4) END AS risk_score,
                   h.first_hard IS NULL AND s.raw >= 0.4 AND s.raw < 0.7 AS stage_b_required,
                   coalesce(s.rule_count, 0) AS rule_count, coalesce(s.triggered_rule_count, 0) AS triggered_rule_count
            FROM pages_x p LEFT JOIN hard h USING (request_id) LEFT JOIN raw_scores s USING (request_id)""",
    }


_ORDER = list(_CTES)


def with_ctes(final: str, upto: str | None = None, extra: dict[str, str] | None = None) -> str:
    """`final` below the CTEs up to `upto` and the extra ones."""
    names = _ORDER[: _ORDER.index(upto) + 1] if upto else []
    ctes = {n: _CTES[n] for n in names} | (extra or {})
    if not ctes:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({text})" for n, text in ctes.items()) + "\n" + final


def from_views(final: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """`final` below input views."""
    return with_ctes(final, extra={n: _VIEW_CTES[n] for n in names} | (extra or {}))


def scoring(final: str, enabled: list[str] | None = None) -> str:
    return with_ctes(final, "signals", scored_ctes(enabled))


__all__ = ["E", "S", "from_views", "scoring", "with_ctes"]
