"""Host, URL and label matching against dimension tables.

Traffic is reduced to its distinct hosts first (a partial aggregation, so a hot host costs one row
per task), matches are found per host by equi joins, and only hosts with a hit are joined back. No
dimension is broadcast by hint: they may grow, so Spark decides from their sizes, at run time too,
and splits skewed partitions otherwise.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import urls as U
from tidegate.operators import scan
from tidegate.sources import dims

GRAM = 4


def distinct_hosts(traffic: DataFrame, url: str = "url") -> DataFrame:
    return traffic.select(U.host(F.col(url)).alias("host")).distinct()


# ------------------------------------------------------------------ threat feed
def listed_domains(feed: DataFrame) -> DataFrame:
    """One row per listed domain: suffix, source (the first by the fixed source order)."""
    rank = F.array_position(F.array(*[F.lit(s) for s in dims.FEED_SOURCE_ORDER]), F.col("source"))
    order = F.when(rank > 0, rank).otherwise(F.lit(len(dims.FEED_SOURCE_ORDER) + 1))
    return (
        feed.filter(F.col("listed") & F.contains("domain", F.lit(".")))
        .groupBy(F.lower("domain").alias("suffix"))
        .agg(F.min_by("source", F.struct(order, F.col("source"))).alias("source"))
    )


def host_suffix_rows(hosts: DataFrame) -> DataFrame:
    """host, pos, suffix: the suffixes of each host, longest first."""
    return hosts.select("host", F.posexplode(U.host_suffixes(U.strip_www(F.col("host")))).alias("pos", "suffix"))


def longest_listed() -> Column:
    """Aggregate: struct<candidate, source> of the longest listed suffix of a host."""
    hit = F.struct(F.col("suffix").alias("candidate"), "source")
    return F.min_by(hit, F.when(F.col("source").isNotNull(), F.col("pos")))


def feed_hits(hosts: DataFrame, feed: DataFrame) -> DataFrame:
    """Hosts with a listed suffix of two labels or more; the longest suffix wins."""
    return (
        host_suffix_rows(hosts)
        .join(listed_domains(feed), "suffix")
        .groupBy("host")
        .agg(longest_listed().alias("feed_hit"))
    )


def verdicts_as_of(
    requests: DataFrame, verdicts: DataFrame, ttl: int = dims.VERDICT_TTL_SECONDS, parts: int | None = None
) -> DataFrame:
    """The latest verdict of a request's domain that is younger than `ttl`; else unknown (null).

    Verdicts and requests lie in one order of domain and time, cut into parts of equal size; the newest
    earlier verdict is carried along, and over the borders of a hot domain's parts.
    """
    micros = ttl * 1_000_000
    seen = verdicts.select(
        F.lit(None).cast("long").alias("request_id"), "domain", F.col("observed_at").alias("at"), F.lit(0).alias("asks"),
        F.struct(F.col("observed_at").alias("at"), "listed", "source").alias("verdict"),
    )
    asked = requests.select("request_id", "domain", F.col("timestamp").alias("at"), F.lit(1).alias("asks"))
    both = asked.unionByName(seen, allowMissingColumns=True)
    fresh = F.unix_micros("at") - F.unix_micros("latest.at") < micros
    return (
        scan.latest(both, ["domain"], ["at", "asks"], "verdict", "latest", parts)
        .filter("asks = 1")
        .select(
            "request_id",
            "domain",
            F.when(fresh, F.col("latest.listed")).alias("listed"),
            F.when(fresh, F.col("latest.source")).alias("source"),
        )
    )


# ------------------------------------------------------------------ privacy filter list
def _grams(text: Column, size: int | Column) -> Column:
    width = size if isinstance(size, Column) else F.lit(size)
    return F.transform(F.sequence(F.lit(1), F.length(text) - (width - 1)), lambda i: F.substring(text, i, width))


def filter_list_hits(hosts: DataFrame, filter_list: DataFrame) -> DataFrame:
    """Hosts that contain a listed domain.

    A containment join without comparing every pair: each listed domain is filed under the rarest of
    its own four-character pieces, hosts are exploded into their pieces, and only equal pieces are
    verified. Domains shorter than a piece are filed under themselves.
    """
    listed = filter_list.select(F.lower("domain").alias("domain")).filter("domain <> ''").distinct()
    pieces = listed.filter(F.length("domain") >= GRAM).select(
        "domain", F.explode(F.array_distinct(_grams(F.col("domain"), GRAM))).alias("gram")
    )
    counts = pieces.groupBy("gram").agg(F.count("*").alias("n"))
    filed = (
        pieces.join(counts, "gram")
        .groupBy("domain")
        .agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    )
    short = listed.filter(F.length("domain") < GRAM).select("domain", F.col("domain").alias("gram"))
    filed = filed.unionByName(short)
    # hosts are cut once, into pieces of those lengths only that the list has
    sizes = filed.agg(F.sort_array(F.collect_set(F.length("gram")))).scalar()
    pieces_of = F.transform("_sizes", lambda n: F.when(F.length("host") >= n, _grams(F.col("host"), n)).otherwise(F.array().cast("array<string>")))
    exploded = hosts.withColumn("_sizes", sizes).select("host", F.explode(F.array_distinct(F.flatten(pieces_of))).alias("gram"))
    return exploded.join(filed, "gram").filter(F.contains("host", "domain")).select("host").distinct()


# ------------------------------------------------------------------ custom blocklist
def classify_blocklist(blocklist: DataFrame) -> DataFrame:
    """Entries as host rules or URL rules: entry, kind, rule_host, url_base, query, has_query."""
    entry = F.col("entry")
    has_scheme = F.contains(entry, F.lit("://"))
    bare_site = (F.btrim(U.path(entry), F.lit("/")) == "") & (U.query(entry) == "")
    is_url = F.when(has_scheme, ~bare_site).otherwise(
        F.contains(entry, F.lit("/")) | F.contains(entry, F.lit("?"))
    )
    rule_host = F.when(has_scheme, U.strip_www(U.host(entry))).otherwise(
        U.strip_www(F.btrim(entry, F.lit(".")))
    )
    return blocklist.select(
        "entry",
        F.when(is_url, F.lit("url")).otherwise(F.lit("host")).alias("kind"),
        F.when(~is_url, rule_host).alias("rule_host"),
        F.when(is_url, url_base(entry)).alias("url_base"),
        F.when(is_url & F.contains(entry, F.lit("?")), url_query(entry)).alias("query"),
    )


def url_base(url: Column) -> Column:
    return F.rtrim(F.regexp_extract(url, r"^[^?]*", 0), F.lit("/"))


def url_query(url: Column) -> Column:
    """Everything after the first question mark."""
    return F.regexp_extract(url, r"(?s)^[^?]*\?(.*)$", 1)


def host_rules(blocklist: DataFrame) -> DataFrame:
    """Suffixes that block a host."""
    return (
        classify_blocklist(blocklist)
        .filter("kind = 'host' and rule_host <> ''")
        .select(F.col("rule_host").alias("suffix"))
        .distinct()
    )


def blocklist_host_hits(hosts: DataFrame, blocklist: DataFrame) -> DataFrame:
    """J3, host rules: hosts equal to or below an entry."""
    return host_suffix_rows(hosts).join(host_rules(blocklist), "suffix", "left_semi").select("host").distinct()


def with_blocklist_url_hit(rows: DataFrame, blocklist: DataFrame, url: str = "url") -> DataFrame:
    """J3, URL rules: adds `blocklist_url_hit`.

    Two equi joins: rules without a query on the base, the others on base and query. Both sides of
    rules are distinct, so no row multiplies however many rules share a base.
    """
    rules = classify_blocklist(blocklist).filter("kind = 'url'")
    any_query = rules.filter("query is null").select(F.col("url_base").alias("_base")).distinct().withColumn("_any", F.lit(True))
    exact = (
        rules.filter("query is not null")
        .select(F.col("url_base").alias("_base"), F.col("query").alias("_query"))
        .distinct()
        .withColumn("_exact", F.lit(True))
    )
    low = F.lower(F.col(url))
    return (
        rows.withColumns({"_base": url_base(low), "_query": F.when(F.contains(low, F.lit("?")), url_query(low))})
        .join(any_query, "_base", "left")
        .join(exact, ["_base", "_query"], "left")
        .withColumn("blocklist_url_hit", F.coalesce("_any", "_exact", F.lit(False)))
        .drop("_base", "_query", "_any", "_exact")
    )


def with_host_flag(rows: DataFrame, hits: DataFrame, flag: str, url: str = "url") -> DataFrame:
    """Adds a boolean: is the row's host among `hits`."""
    marked = hits.select(F.col("host").alias("_host"), F.lit(True).alias(flag))
    return (
        rows.withColumn("_host", U.host(F.col(url)))
        .join(marked, "_host", "left")
        .withColumn(flag, F.coalesce(flag, F.lit(False)))
        .drop("_host")
    )


def with_blocklist(rows: DataFrame, blocklist: DataFrame, url: str = "url") -> DataFrame:
    """Adds `blocklisted` by host and URL rules."""
    hosts = distinct_hosts(rows, url)
    by_host = with_host_flag(rows, blocklist_host_hits(hosts, blocklist), "blocklist_host_hit", url)
    return (
        with_blocklist_url_hit(by_host, blocklist, url)
        .withColumn("blocklisted", F.col("blocklist_host_hit") | F.col("blocklist_url_hit"))
        .drop("blocklist_host_hit", "blocklist_url_hit")
    )


def with_filter_list(rows: DataFrame, filter_list: DataFrame, url: str = "url") -> DataFrame:
    """F8: adds `host_listed`."""
    return with_host_flag(rows, filter_list_hits(distinct_hosts(rows, url), filter_list), "host_listed", url)


# ------------------------------------------------------------------ brands
def _literal(rows, ddl: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), ddl)


def brand_mismatch(title: Column, host: Column, rows=None) -> Column:
    """The first brand named in the title whose official domains do not cover the host.

    The brand table is fixed configuration, so it is one literal and rows stay where they are.
    """
    grouped: dict[str, list[str]] = {}
    for brand, _, domain, _, _ in dims.brand_rows() if rows is None else rows:
        grouped.setdefault(brand, []).append(domain)
    table = [{"brand": b, "domains": d} for b, d in grouped.items()]
    brands = _literal(table, "array<struct<brand:string,domains:array<string>>>")
    low, bare = F.lower(title), U.strip_www(host)
    named = F.filter(
        brands,
        lambda b: F.contains(low, b["brand"])
        & ~F.exists(b["domains"], lambda d: U.domain_matches(bare, d)),
    )
    any_brand = "|".join(map(re.escape, grouped)) or "(?!)"
    return F.when(low.rlike(any_brand), F.try_element_at(named, F.lit(1))["brand"])


def official_labels(rows=None) -> list[str]:
    """A4: distinct labels of all official domains, in brand order."""
    return list(dict.fromkeys(label for *_, label in (dims.brand_rows() if rows is None else rows)))


def labels_by_list(names: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(name, label) of distinct `name`s by a whole public suffix list, one entry a row in `suffix`.

    Names are exploded into their suffixes, which meet the list by key: entries as they are, `*.`
    entries by the suffix without its first label, `!` entries as exceptions.
    """
    entry = F.lower(F.trim("suffix"))
    rules = suffixes.select(F.regexp_replace(entry, r"^(\*\.|!)", "").alias("_key"), F.left(entry, F.lit(1)).alias("_mark")).filter("_key <> ''")
    exact = rules.groupBy("_key").agg(
        F.bool_or(~F.col("_mark").isin("*", "!")).alias("_plain"), F.bool_or(F.col("_mark") == "!").alias("_kept")
    )
    wild = rules.filter("_mark = '*'").select(F.col("_key").alias("_parent"), F.lit(True).alias("_wild")).distinct()
    parts = F.split("name", r"\.")
    listed = F.coalesce(F.col("_plain") | F.col("_wild"), "_plain", "_wild", F.lit(False)) & ~F.coalesce("_kept", F.lit(False))
    return (
        names.select("name").distinct()
        .select("name", F.posexplode(U.host_suffixes(F.col("name"))).alias("_pos", "_key"))
        .withColumn("_parent", F.regexp_replace("_key", r"^[^.]*\.", ""))
        .join(exact, "_key", "left")
        .join(wild, "_parent", "left")
        .groupBy("name")
        .agg(F.min(F.when(listed, F.col("_pos"))).alias("_first"))
        .select("name", parts[F.greatest(F.coalesce("_first", F.size(parts) - 1) - 1, F.lit(0))].alias("label"))
    )


def with_labels(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds the label of a host, `own`, and the one after look-alike characters are replaced, `plain`.

    `suffixes` is a whole public suffix list as a table; without it the built-in subset counts.
    """
    bare = U.strip_www(F.col("host"))
    plain = U.normalize_confusables(bare)
    if suffixes is None:
        return hosts.withColumns({"own": U.sld_label(bare), "plain": U.sld_label(plain)})
    named = hosts.withColumns({"_bare": bare, "_plain_name": plain})
    names = named.select(F.explode(F.array("_bare", "_plain_name")).alias("name"))
    labels = labels_by_list(names, suffixes)
    return (
        named.join(labels.select(F.col("name").alias("_bare"), F.col("label").alias("own")), "_bare", "left")
        .join(labels.select(F.col("name").alias("_plain_name"), F.col("label").alias("plain")), "_plain_name", "left")
        .drop("_bare", "_plain_name")
    )


def officials_by_list(brands: DataFrame, suffixes: DataFrame) -> Column:
    """array<struct<domain,label>> of a fixed brand table, labelled by the same list, as a scalar subquery.

    Of the domains that share a label the first one counts, as for the built-in labels.
    """
    labels = labels_by_list(brands.select(F.col("domain").alias("name")), suffixes).withColumnRenamed("name", "domain")
    order = F.struct("brand_ord", "domain_ord")
    first = brands.drop("label").join(labels, "domain").groupBy("label").agg(F.min(order).alias("ord"), F.min_by("domain", order).alias("domain"))
    rows = F.array_sort(F.collect_list(F.struct("ord", "domain", "label")))
    return first.agg(F.transform(rows, lambda r: F.struct(r["domain"].alias("domain"), r["label"].alias("label")))).scalar()


def is_official(own: Column, plain: Column, rows=None, officials: Column | None = None) -> Column:
    known = U.among(plain, official_labels(rows)) if officials is None else F.array_contains(officials["label"], plain)
    return (own == plain) & known


def _first_imitated(officials: Column, p: Column) -> Column:
    hits = F.filter(
        officials,
        lambda o: F.when(p["plain"] == o["label"], p["own"] != o["label"]).otherwise(
            U.is_typosquat(p["plain"], o["label"])
        ),
    )
    named = F.transform(
        F.slice(hits, 1, 1),
        lambda o: F.struct(
            F.when(p["plain"] == o["label"], F.lit("confusable")).otherwise(F.lit("typosquat")).alias("kind"),
            o["domain"].alias("official"),
        ),
    )
    return F.try_element_at(named, F.lit(1))


def typosquat_hit(
    host: Column, own: Column, plain: Column, rows=None, strict: bool = True, officials: Column | None = None
) -> Column:
    """struct<kind, official> of the first official domain a host imitates, or null.

    Only the first domain of a label can be the first hit, so later ones are left out. With
    `strict=False` a host whose own label is official is never a hit, even where the substitution
    of look-alike characters changes that label. `officials` replaces the array made of `rows`.
    """
    table, seen, given = [], set(), officials
    for _, _, domain, _, label in dims.brand_rows() if rows is None else rows:
        if label not in seen:
            seen.add(label)
            table.append({"domain": domain, "label": label})
    if given is None:
        officials = _literal(table, "array<struct<domain:string,label:string>>")
    exempt = U.is_ip(U.strip_www(host)) | is_official(own, plain, rows, given)
    if not strict:
        exempt = exempt | (U.among(own, sorted(seen)) if given is None else F.array_contains(given["label"], own))

    # A one-element array binds the labels, so that the search does not derive them per official row.
    pair = F.struct(own.alias("own"), plain.alias("plain"))
    first = F.transform(F.array(pair), lambda p: _first_imitated(officials, p))[0]
    return F.when(~exempt, first)


def _deletions(text: Column) -> Column:
    """Every text that lacks one character of `text`."""
    return F.transform(
        F.sequence(F.lit(1), F.length(text)),
        lambda i: F.concat(F.left(text, i - 1), F.substring(text, i + 1, F.length(text))),
    )


def deletion_keys(label: Column) -> Column:
    """The label without up to two of its characters: labels two edits apart share such a key."""
    once = _deletions(label)
    twice = F.flatten(F.transform(F.filter(once, lambda t: t != ""), _deletions))
    return F.array_distinct(F.concat(F.array(label), once, twice))


def similar_labels(labels: DataFrame, officials: DataFrame) -> DataFrame:
    """J5 for brand tables of any size: (label, official) pairs by the edit-distance rule.

    An equi join on deletion keys; only labels that share a key are verified. Both inputs have one
    column `label`. A label more than two characters longer than the longest official one cannot match
    and makes no keys.
    """
    theirs = officials.select(F.col("label").alias("official")).filter(F.length("official") >= 3).distinct()
    longest = theirs.agg(F.max(F.length("official"))).scalar()
    ours = labels.filter((F.length("label") >= 3) & (F.length("label") <= longest + 2)).distinct()
    pairs = ours.withColumn("key", F.explode(deletion_keys(F.col("label")))).join(
        theirs.withColumn("key", F.explode(deletion_keys(F.col("official")))), "key"
    )
    close = pairs.filter(U.is_typosquat(F.col("label"), F.col("official")))
    return close.select("label", "official").distinct()


def typosquat_hits(hosts: DataFrame, brands: DataFrame) -> DataFrame:
    """J5 as joins with a brand table: host, kind and first official domain of every imitating host."""
    order = F.struct("brand_ord", "domain_ord")
    officials = brands.groupBy("label").agg(
        F.min(order).alias("ord"), F.min_by("domain", order).alias("official")
    )
    labelled = with_labels(hosts).filter(~U.is_ip(U.strip_www(F.col("host"))))
    exact = officials.select(F.col("label").alias("plain"), F.lit(True).alias("known"))
    suspects = (
        labelled.join(exact, "plain", "left")
        .filter(F.col("known").isNull() | (F.col("own") != F.col("plain")))
        .select("host", "own", "plain")
    )
    near = similar_labels(suspects.select(F.col("plain").alias("label")), officials)
    pairs = near.select(F.col("label").alias("plain"), F.col("official").alias("label"), F.lit("typosquat").alias("kind"))
    same = officials.select(F.col("label").alias("plain"), "label", F.lit("confusable").alias("kind"))
    return (
        suspects.join(pairs.unionByName(same), "plain")
        .filter((F.col("kind") == "typosquat") | (F.col("own") != F.col("label")))
        .join(officials, "label")
        .groupBy("host")
        .agg(F.min_by(F.struct("kind", "official"), "ord").alias("hit"))
        .select("host", "hit.kind", "hit.official")
    )
