"""Rules, ordered evaluation and scoring.

Page bodies are read once, inside their row; everything that needs a join works on hosts. The
enablement of rules is a small configuration known when the plan is built, so a disabled rule
leaves no work in the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import html as H
from tidegate.functions import urls as U
from tidegate.operators import matching as M
from tidegate.operators import pages as P
from tidegate.sources import dims
from tidegate.sources.dims import RuleDef

Verdict = tuple[Column, Column]
SKIPPED = "Skipped — prior hard-block rule triggered"


# ------------------------------------------------------------------ page signals
def redirect_targets(body: Column, page_host: Column) -> Column:
    """struct<vector, host> of the first redirect to another host, by pattern order, else null."""
    found = []
    for pattern, vector in dims.REDIRECT_PATTERNS:
        hosts = F.transform(
            F.regexp_extract_all(body, F.lit("(?i)" + pattern), F.lit(1)), lambda t: U.host(F.trim(t))
        )
        name = F.lit(vector).alias("vector")
        found.append(F.transform(hosts, _pair_with(name)))
    away = F.filter(
        F.concat(*found), lambda r: (r["host"] != "") & (U.strip_www(r["host"]) != U.strip_www(page_host))
    )
    return F.when(body.rlike("(?i)location|refresh"), F.try_element_at(away, F.lit(1)))


def _pair_with(name: Column) -> Callable[[Column], Column]:
    return lambda h: F.struct(name, h.alias("host"))


def external_form_host(forms: Column, hot_inputs: Column, page_host: Column) -> Column:
    """Host of the first form that sends sensitive inputs to another host, else null."""
    away = F.filter(
        forms,
        lambda f: (f["action_host"] != "")
        & (U.strip_www(f["action_host"]) != U.strip_www(page_host))
        & F.exists(hot_inputs, lambda i: P.encloses(f, i["pos"])),
    )
    return F.try_element_at(away, F.lit(1))["action_host"]


def page_signals(
    traffic: DataFrame,
    enabled: Mapping[str, bool] | None = None,
    body: str = "body",
    headers: str = "req_headers",
    keep: tuple[str, ...] = ("request_id", "url", "method"),
    brands=None,
) -> DataFrame:
    """Thin rows with `scheme`, `host` and what the page rules need; bodies end here.

    A page that the encryption rule blocks is not read, because its page rules are skipped.
    """
    on = _enabled(enabled)
    base = P.html_pages(traffic, body, headers).select(
        *keep,
        U.scheme(F.col("url")).alias("scheme"),
        U.host(F.col("url")).alias("host"),
        "raw_body",
    )
    if on("unencrypted_connection"):
        base = base.withColumn("raw_body", F.when(~unencrypted(), F.col("raw_body")))
    if not any(on(r) for r in PAGE_RULES):
        return base.drop("raw_body")
    live = base.withColumn(
        "live_html",
        F.when(F.col("raw_body").rlike("(?i)<(?:input|title)"), H.without_inert(F.col("raw_body"))),
    )
    has_inputs = F.col("live_html").rlike("(?i)<input")
    tokens = live.withColumn("tokens", F.when(has_inputs, H.tag_tokens(F.col("live_html"))))
    hot = F.filter("inputs", lambda i: H.is_sensitive(i["type"], i["name"], i["id"]))
    signals = (
        P.with_forms(tokens)
        .withColumns(
            {"hot_inputs": hot, "title": F.coalesce(H.title(F.col("live_html")), F.lit(""))}
        )
        .withColumn("sensitive", F.coalesce(F.size("hot_inputs"), F.lit(0)) > 0)
    )
    title, host = F.col("title"), F.col("host")
    out = [*keep, "scheme", "host", F.col("raw_body").isNotNull().alias("has_dom"), "title", "sensitive"]
    if on("brand_domain_mismatch"):
        out.append(F.when(title != "", M.brand_mismatch(title, host, brands)).alias("brand_hit"))
    if on("unexpected_redirect"):
        out.append(
            F.when(F.col("sensitive"), redirect_targets(F.col("raw_body"), host)).alias("redirect_hit")
        )
    if on("external_form_action"):
        out.append(
            F.when(
                F.col("sensitive"), external_form_host(F.col("forms"), F.col("hot_inputs"), host)
            ).alias("form_hit")
        )
    return signals.select(*out)


def host_signals(
    hosts: DataFrame,
    feed: DataFrame | None = None,
    blocklist: DataFrame | None = None,
    enabled: Mapping[str, bool] | None = None,
    brands=None,
    strict: bool = True,
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """Per host with something to say: `feed_hit`, `typosquat_hit`, `official`, `blocklist_host_hit`.

    One pass: hosts are exploded into suffixes, both lists join on the suffix, and the grouping by
    host reuses the partitioning of the distinct hosts where the lists are small.
    """
    on = _enabled(enabled)
    use_feed = feed is not None and on("domain_blacklist")
    use_blocks = blocklist is not None and on("custom_blacklist")
    none_hit, none_typo = "struct<candidate:string,source:string>", "struct<kind:string,official:string>"
    found = hosts
    if use_feed or use_blocks:
        rows, aggregates = M.host_suffix_rows(hosts), []
        if use_feed:
            rows = rows.join(M.listed_domains(feed), "suffix", "left")
            aggregates.append(M.longest_listed().alias("feed_hit"))
        if use_blocks:
            blocks = M.host_rules(blocklist).withColumn("blocks", F.lit(True))
            rows = rows.join(blocks, "suffix", "left")
            aggregates.append(F.bool_or("blocks").alias("blocklist_host_hit"))
        found = rows.groupBy("host").agg(*aggregates)
    extra = {}
    if not use_feed:
        extra["feed_hit"] = F.lit(None).cast(none_hit)
    if not use_blocks:
        extra["blocklist_host_hit"] = F.lit(None).cast("boolean")
    if on("typosquatting"):
        found = M.with_labels(found, suffixes)
        own, plain, officials = F.col("own"), F.col("plain"), None
        if suffixes is not None:
            found = found.withColumn("_officials", M.officials_by_list(dims.brand_domains(hosts.sparkSession, brands), suffixes))
            officials = F.col("_officials")
        extra["typosquat_hit"] = M.typosquat_hit(F.col("host"), own, plain, brands, strict, officials)
        extra["official"] = M.is_official(own, plain, brands, officials)
    else:
        extra |= {"typosquat_hit": F.lit(None).cast(none_typo), "official": F.lit(False)}
    return (
        found.withColumns(extra)
        .drop("own", "plain", "_officials")
        .filter(
            F.col("typosquat_hit").isNotNull()
            | F.col("official")
            | F.col("feed_hit").isNotNull()
            | F.col("blocklist_host_hit").isNotNull()
        )
    )


# ------------------------------------------------------------------ rules
def _verdict(hit: Column, explanation: Column, miss: Column) -> Verdict:
    sure = F.coalesce(hit, F.lit(False))
    return F.when(sure, F.lit(1.0)).otherwise(F.lit(0.0)), F.when(sure, explanation).otherwise(miss)


def unencrypted(scheme: str = "scheme", host: str = "host") -> Column:
    return (F.col(scheme) != "https") & ~U.is_loopback(F.col(host))


def rule_domain_blacklist() -> Verdict:
    """R1."""
    hit = F.col("feed_hit")
    return _verdict(
        hit.isNotNull(),
        F.format_string("Domain '%s' found in %s threat database", hit["candidate"], hit["source"]),
        F.lit("Domain not found in threat database"),
    )


def rule_unencrypted() -> Verdict:
    """R2."""
    return _verdict(
        unencrypted(),
        F.format_string("Connection is unencrypted ('%s://')", F.col("scheme")),
        F.when(F.col("scheme") == "https", F.lit("Connection is encrypted (HTTPS)")).otherwise(
            F.lit("Local loopback; HTTP is acceptable for local development")
        ),
    )


def rule_sensitive() -> Verdict:
    """R3."""
    return _verdict(
        F.col("sensitive"),
        F.lit("Page contains input fields associated with credential or secret collection"),
        F.lit("No sensitive input fields detected"),
    )


def rule_brand() -> Verdict:
    """R4."""
    return _verdict(
        F.col("brand_hit").isNotNull(),
        F.format_string(
            "Page title references brand '%s' but is hosted on non-official domain '%s'",
            F.col("brand_hit"),
            U.strip_www(F.col("host")),
        ),
        F.when(F.col("has_dom"), F.lit("No brand-domain mismatch detected")).otherwise(
            F.lit("No DOM content to inspect")
        ),
    )


def rule_redirect() -> Verdict:
    """R5."""
    hit = F.col("redirect_hit")
    return _verdict(
        hit.isNotNull(),
        F.format_string(
            "%s redirects to external domain '%s' during a sensitive interaction", hit["vector"], hit["host"]
        ),
        F.when(
            F.col("sensitive"), F.lit("No unexpected external redirect detected during sensitive interaction")
        ).otherwise(F.lit("No sensitive interaction context to evaluate")),
    )


def rule_form_action() -> Verdict:
    """R6."""
    return _verdict(
        F.col("form_hit").isNotNull(),
        F.format_string("A form with sensitive fields submits to external domain '%s'", F.col("form_hit")),
        F.when(F.col("has_dom"), F.lit("No external form action with sensitive fields detected")).otherwise(
            F.lit("No DOM content to inspect")
        ),
    )


def rule_typosquat() -> Verdict:
    """R7."""
    hit, bare = F.col("typosquat_hit"), U.strip_www(F.col("host"))
    return _verdict(
        hit.isNotNull(),
        F.when(
            hit["kind"] == "confusable",
            F.format_string("Domain '%s' uses confusable characters to impersonate '%s'", bare, hit["official"]),
        ).otherwise(F.format_string("Domain '%s' appears to be a typosquat of '%s'", bare, hit["official"])),
        F.when(U.is_ip(bare), F.lit("IP address — typosquatting check not applicable"))
        .when(F.col("official"), F.lit("Domain label is a known official brand (not a typosquat of another brand)"))
        .otherwise(F.lit("No typosquatting pattern detected")),
    )


def rule_ip() -> Verdict:
    """R8."""
    return _verdict(
        U.is_ip(F.col("host")),
        F.format_string("Page accessed via raw IP address '%s'", F.col("host")),
        F.lit("Page uses a registered domain name"),
    )


def rule_custom() -> Verdict:
    """R9."""
    return _verdict(
        F.col("blocklisted"),
        F.format_string("URL '%s' matches the custom local blacklist", F.col("url")),
        F.when(F.col("blocklist_configured"), F.lit("Not found in custom local blacklist")).otherwise(
            F.lit("Custom blacklist not configured")
        ),
    )


PAGE_RULES = ("sensitive_fields", "brand_domain_mismatch", "unexpected_redirect", "external_form_action")
BUILT_IN: dict[str, Callable[[], Verdict]] = {
    "domain_blacklist": rule_domain_blacklist,
    "unencrypted_connection": rule_unencrypted,
    "sensitive_fields": rule_sensitive,
    "brand_domain_mismatch": rule_brand,
    "unexpected_redirect": rule_redirect,
    "external_form_action": rule_form_action,
    "typosquatting": rule_typosquat,
    "ip_based_url": rule_ip,
    "custom_blacklist": rule_custom,
}


@dataclass(frozen=True)
class RuleBook:
    """Rules in evaluation order with their verdict functions."""

    rules: tuple[RuleDef, ...] = tuple(dims.RULE_REGISTRY)
    functions: Mapping[str, Callable[[], Verdict]] = field(default_factory=lambda: dict(BUILT_IN))

    def register_rule(
        self,
        rule_id: str,
        description: str,
        weight: float,
        hard_block: bool,
        fn: Callable[[], Verdict],
        rule_type: str = "deterministic",
        compute_class: str = "cheap",
    ) -> RuleBook:
        """A new book with one more rule at the end.

        `fn` returns (score, explanation) columns over the prepared columns of `prepare`. A
        contextual rule runs only where the deterministic score is ambiguous.
        """
        if any(r.rule_id == rule_id for r in self.rules):
            raise ValueError(f"rule {rule_id} is already registered")
        rule = RuleDef(rule_id, description, weight, hard_block, rule_type, compute_class)
        return replace(self, rules=(*self.rules, rule), functions={**self.functions, rule_id: fn})


def _enabled(enabled: Mapping[str, bool] | None) -> Callable[[str], bool]:
    table = enabled or {}
    return lambda rule_id: table.get(rule_id, True)


def with_book(enabled: Mapping[str, bool] | None, book: RuleBook | None) -> Mapping[str, bool] | None:
    """Built-in rules that a book leaves out are disabled."""
    if book is None:
        return enabled
    listed = {r.rule_id for r in book.rules}
    return {**(enabled or {}), **{r: False for r in BUILT_IN if r not in listed}}


def prepare(
    traffic: DataFrame,
    feed: DataFrame | None = None,
    blocklist: DataFrame | None = None,
    enabled: Mapping[str, bool] | None = None,
    body: str = "body",
    headers: str = "req_headers",
    keep: tuple[str, ...] = ("request_id", "url", "method"),
    brands=None,
    strict: bool = True,
    hosts: DataFrame | None = None,
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """Thin rows with every column the rules read.

    `hosts` spares a second pass over the addresses where the distinct hosts are known already.
    `suffixes` is a whole public suffix list (`suffix`), which labels hosts and brand domains.
    """
    rows = page_signals(traffic, enabled, body, headers, keep, brands)
    hosts = M.distinct_hosts(traffic) if hosts is None else hosts
    return with_host_rules(rows, hosts, feed, blocklist, enabled, brands, strict, suffixes)


def with_host_rules(
    rows: DataFrame,
    hosts: DataFrame,
    feed: DataFrame | None = None,
    blocklist: DataFrame | None = None,
    enabled: Mapping[str, bool] | None = None,
    brands=None,
    strict: bool = True,
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """The second half of `prepare`: thin rows of `page_signals` with what lists and labels say."""
    on = _enabled(enabled)
    defaults = {
        "has_dom": "boolean", "title": "string", "sensitive": "boolean", "brand_hit": "string",
        "redirect_hit": "struct<vector:string,host:string>", "form_hit": "string",
    }
    for name, kind in defaults.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.join(host_signals(hosts, feed, blocklist, enabled, brands, strict, suffixes), "host", "left")
    configured = F.lit(False)
    if blocklist is not None and on("custom_blacklist"):
        rows = M.with_blocklist_url_hit(rows, blocklist)
        configured = blocklist.agg(F.count("*") > 0).scalar()
    else:
        rows = rows.withColumn("blocklist_url_hit", F.lit(False))
    return rows.withColumn(
        "blocklisted", F.coalesce("blocklist_host_hit", F.lit(False)) | F.col("blocklist_url_hit")
    ).withColumn("blocklist_configured", configured)


def weighted_score(terms: list[tuple[Column, float]]) -> Column:
    """Weighted mean in rule order, so that it is the same to the last bit everywhere."""
    total, weighted = 0.0, F.lit(0.0)
    for score, weight in terms:
        weighted = weighted + score * F.lit(weight)
        total += weight
    return weighted / F.lit(total) if total > 0 else F.lit(0.0)


def decide(score: Column) -> Column:
    """R12, the decision."""
    return (
        F.when(score >= dims.BLOCK_AT, F.lit("block")).when(score >= dims.WARN_AT, F.lit("warn")).otherwise(F.lit("allow"))
    )


def needs_second_stage(score: Column) -> Column:
    """R12, the band."""
    return (score >= dims.WARN_AT) & (score < dims.BLOCK_AT)


def score_rows(
    rows: DataFrame, enabled: Mapping[str, bool] | None = None, book: RuleBook | None = None
) -> DataFrame:
    """R10–R12 over prepared rows: decision, risk_score, flags and `rule_results`."""
    book, on = book or RuleBook(), _enabled(enabled)
    passthrough = [
        c for c in rows.columns
        if c not in ("blocklist_host_hit", "blocklist_url_hit", "feed_hit", "typosquat_hit", "official", "brand_hit",
                     "redirect_hit", "form_hit", "has_dom", "blocklisted", "blocklist_configured")
    ]
    ordered = [r for r in book.rules if r.rule_type != "contextual"]
    contextual = [r for r in book.rules if r.rule_type == "contextual" and on(r.rule_id)]
    wide = rows
    for rule in [r for r in ordered if on(r.rule_id)] + contextual:
        score, why = book.functions[rule.rule_id]()
        wide = wide.withColumns({f"s_{rule.rule_id}": score, f"e_{rule.rule_id}": why})

    hard = [
        F.when(F.col(f"s_{r.rule_id}") > 0, F.lit(i))
        for i, r in enumerate(ordered, start=1)
        if r.hard_block and on(r.rule_id)
    ]
    first_hard = F.coalesce(*hard) if hard else F.lit(None).cast("int")
    initial = weighted_score([(F.col(f"s_{r.rule_id}"), r.weight) for r in ordered if on(r.rule_id)])
    wide = wide.withColumns({"first_hard": first_hard, "initial_score": initial})
    blocked = F.col("first_hard").isNotNull()
    ambiguous = ~blocked & (F.col("initial_score") >= dims.AMBIGUOUS_AT) & (F.col("initial_score") < dims.BLOCK_AT)
    final = F.col("initial_score")
    if contextual:
        every = [(F.col(f"s_{r.rule_id}"), r.weight) for r in [*(o for o in ordered if on(o.rule_id)), *contextual]]
        final = F.when(ambiguous, weighted_score(every)).otherwise(final)
    wide = wide.withColumn("final_score", final)

    def result(rule: RuleDef, ordinal: int, score: Column, why: Column) -> Column:
        return F.struct(
            F.lit(ordinal).alias("ordinal"),
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.rule_type).alias("rule_type"),
            score.alias("score"),
            F.lit(rule.hard_block).alias("hard_block"),
            why.alias("explanation"),
            F.coalesce(score > 0, F.lit(False)).alias("triggered"),
        )

    results = []
    for i, rule in enumerate(ordered, start=1):
        skipped = result(rule, i, F.lit(None).cast("double"), F.lit(SKIPPED))
        after = F.col("first_hard") < i
        if on(rule.rule_id):
            ran = result(rule, i, F.col(f"s_{rule.rule_id}"), F.col(f"e_{rule.rule_id}"))
            results.append(F.when(after, skipped).otherwise(ran))
        else:
            results.append(F.when(after, skipped))
    for i, rule in enumerate(contextual, start=len(ordered) + 1):
        results.append(
            F.when(ambiguous, result(rule, i, F.col(f"s_{rule.rule_id}"), F.col(f"e_{rule.rule_id}")))
        )
    score = F.col("final_score")
    return wide.select(
        *passthrough,
        F.when(blocked, F.lit("block")).otherwise(decide(score)).alias("decision"),
        F.when(blocked, F.lit(1.0)).otherwise(F.round(score, 4)).alias("risk_score"),
        blocked.alias("hard_block_triggered"),
        (~blocked & needs_second_stage(score)).alias("stage_b_required"),
        F.array_compact(F.array(*results)).alias("rule_results"),
    )


def evaluate(
    traffic: DataFrame,
    feed: DataFrame | None = None,
    blocklist: DataFrame | None = None,
    enabled: Mapping[str, bool] | None = None,
    book: RuleBook | None = None,
    **options,
) -> DataFrame:
    """Traffic to scored rows. `options` are those of `prepare`."""
    enabled = with_book(enabled, book)
    return score_rows(prepare(traffic, feed, blocklist, enabled, **options), enabled, book)


def evaluate_responses(
    traffic: DataFrame,
    filter_list: DataFrame,
    feed: DataFrame | None = None,
    blocklist: DataFrame | None = None,
    enabled: Mapping[str, bool] | None = None,
) -> DataFrame:
    """Response analysis: the eligible responses, through the same rules."""
    from tidegate.operators import filters as T

    # Whatever needs no join filters first; the list of hosts then meets thin rows, not bodies.
    ignored = T.should_ignore_response(
        F.col("url"), F.col("method"), F.col("req_headers"), F.col("status_code"),
        F.col("resp_headers"), F.col("resp_body"), F.lit(False),
    )
    rows = prepare(traffic.filter(~ignored), feed, blocklist, enabled, "resp_body", "resp_headers")
    eligible = M.with_filter_list(rows, filter_list).filter(~F.col("host_listed")).drop("host_listed")
    return score_rows(eligible, enabled)


def rule_results(scored: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per event and rule; disabled rules are absent, skipped ones have a null score."""
    return scored.select(key, F.inline("rule_results"))


def triggered_evidence(scored: DataFrame) -> DataFrame:
    """Rule results with a score other than null and zero."""
    return scored.withColumn(
        "rule_results",
        F.filter("rule_results", lambda r: F.coalesce(r["score"] != 0, F.lit(False))),
    )


def rule_counts(scored: DataFrame, key: str = "request_id") -> DataFrame:
    """A2: rule and triggered-rule counts per event, without a shuffle."""
    return scored.select(
        key,
        F.size("rule_results").alias("rule_count"),
        F.size(F.filter("rule_results", lambda r: r["triggered"])).alias("triggered_rule_count"),
    )


def enablement_map(rules: DataFrame | None, book: RuleBook | None = None) -> dict[str, bool]:
    """Enablement of the known rules; missing rules, or a table that is missing or has
    other columns, mean enabled. Any other failure is raised.

    At most one row per known rule reaches the driver.
    """
    known = [r.rule_id for r in (book or RuleBook()).rules]
    if rules is None:
        return {}
    try:
        flags = rules.filter(F.col("rule_code").isin(known)).groupBy("rule_code")
        rows = flags.agg(F.bool_or("is_enabled").alias("is_enabled")).collect()
    except AnalysisException:
        return {}
    return {r["rule_code"]: bool(r["is_enabled"]) for r in rows}
