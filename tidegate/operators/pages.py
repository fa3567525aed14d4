"""Page extraction: from page bodies to relational outputs.

A page's features are computed inside its own row, so extraction is one narrow stage; the relational
tables are explodes of it. No body is shuffled. The explodes are outer ones with a null test above: for
a plain one the optimizer puts a size test below it, and with that the whole parse a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import html as H
from tidegate.functions import text as X
from tidegate.functions import urls as U


def html_pages(
    traffic: DataFrame, body: str = "body", headers: str = "req_headers", max_bytes: int | None = None
) -> DataFrame:
    """Adds `is_html` and `raw_body` (null unless the page is HTML with a non-empty body).

    Bodies are taken whole; `max_bytes` cuts them on request.
    """
    binary = dict(traffic.dtypes)[body] == "binary"
    is_html = F.contains(F.lower(X.header(F.col(headers), "content-type")), F.lit("text/html"))
    has_body = F.octet_length(body) > 0
    return traffic.withColumn("is_html", is_html).withColumn(
        "raw_body", F.when(F.col("is_html") & has_body, H.decoded_body(F.col(body), binary, max_bytes))
    )


def with_tokens(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds `live_html` and `tokens` for the other extractors."""
    return pages.withColumn("live_html", H.without_inert(F.col(html))).withColumn(
        "tokens", H.tag_tokens(F.col("live_html"))
    )


_FORM_TAGS = r"(?i)^<(?:form|input)(?=[\s/>])"
_ENTRIES = "array<struct<kind:string,form_no:int,pos:int,inputs:int,raw:string>>"


def _form_struct(entry: Column, ends: Column, url: Column) -> Column:
    action = F.coalesce(H.attribute(entry["attrs"], "action"), F.lit(""))
    # the size test names the map a second time, so that it stays a column and is built once
    end = F.when(F.size(ends) > 0, F.try_element_at(ends, entry["form_no"]))
    return F.struct(
        entry["form_no"].alias("form_no"),
        action.alias("action"),
        F.lower(F.coalesce(H.attribute(entry["attrs"], "method"), F.lit("get"))).alias("method"),
        U.joined_host(url, action).alias("action_host"),
        entry["pos"].alias("from_pos"),
        F.coalesce(end["pos"], F.lit(2**31 - 1)).alias("to_pos"),
        entry["inputs"].alias("from_input"),
        F.coalesce(end["inputs"], F.lit(2**31 - 1)).alias("to_input"),
    )


def _input_struct(entry: Column) -> Column:
    attrs = entry["attrs"]
    return F.struct(
        entry["form_no"].alias("form_no"),
        entry["pos"].alias("pos"),
        F.lower(F.coalesce(H.attribute(attrs, "type"), F.lit("text"))).alias("type"),
        F.coalesce(H.attribute(attrs, "name"), F.lit("")).alias("name"),
        F.coalesce(H.attribute(attrs, "id"), F.lit("")).alias("id"),
    )


def with_forms(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds arrays `forms` and `inputs`; needs `tokens`.

    A form covers the positions between `from_pos` and `to_pos`, and of the inputs those behind the first
    `from_input` and up to `to_input`; an input carries its position and its innermost form.
    """
    entries = F.col("form_entries")
    has_inputs = F.exists("tokens", lambda t: t.rlike(_FORM_TAGS))
    nested = F.when(has_inputs, H.nest_forms(F.col("tokens"))).otherwise(F.array().cast(_ENTRIES))
    parsed = F.transform(
        nested,
        lambda e: F.struct(
            e["kind"].alias("kind"),
            e["form_no"].alias("form_no"),
            e["pos"].alias("pos"),
            e["inputs"].alias("inputs"),
            F.when(e["kind"] != "close", H.attributes(e["raw"])).alias("attrs"),
        ),
    )
    closed = F.filter(entries, lambda e: e["kind"] == "close")
    ends = F.map_from_entries(F.transform(closed, lambda e: F.struct(e["form_no"].alias("n"), F.struct(e["pos"].alias("pos"), e["inputs"].alias("inputs")).alias("p"))))
    return (
        pages.withColumn("form_entries", parsed)
        .withColumn("form_ends", ends)
        .withColumns(
            {
                "forms": F.transform(
                    F.filter(entries, lambda e: e["kind"] == "open"),
                    lambda e: _form_struct(e, F.col("form_ends"), F.col(url)),
                ),
                "inputs": F.transform(F.filter(entries, lambda e: e["kind"] == "input"), _input_struct),
            }
        )
        .drop("form_entries", "form_ends")
    )


def encloses(form: Column, pos: Column) -> Column:
    return (form["from_pos"] < pos) & (pos < form["to_pos"])


def page_tags(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per tag: key, pos, tag, closing, raw."""
    tokens = with_tokens(pages.select(key, html), html).select(key, "tokens")
    return tokens.select(key, F.posexplode_outer("tokens").alias("pos", "raw")).where("pos IS NOT NULL").select(
        key,
        (F.col("pos") + 1).alias("pos"),
        H.tag_name(F.col("raw")).alias("tag"),
        F.col("raw").startswith("</").alias("closing"),
        "raw",
    )


def page_titles(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """P3."""
    live = pages.select(key, H.without_inert(F.col(html)).alias("live_html"))
    return live.select(key, H.title(F.col("live_html")).alias("title"))


def page_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """P4."""
    live = pages.select(key, H.without_inert(F.col(html)).alias("live_html"))
    return live.select(key, H.visible_text(F.col("live_html")).alias("text"))


def _formed(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    return with_forms(with_tokens(pages.select(key, url, html), html), url)


def page_forms(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """P5: one row per form: key, form_no, action, method, action_host."""
    return (
        _formed(pages, key, html, url)
        .select(key, F.inline_outer("forms"))
        .where("form_no IS NOT NULL")
        .select(key, "form_no", "action", "method", "action_host")
    )


def page_inputs(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """One row per input and enclosing form (null `form_no` outside any form), in order."""
    formed = _formed(pages, key, html, url).select(key, "forms", F.posexplode_outer("inputs").alias("i", "input"))
    formed = formed.where("i IS NOT NULL")
    around = F.transform(
        F.filter("forms", lambda f: encloses(f, F.col("input.pos"))), lambda f: f["form_no"]
    )
    return formed.select(key, "i", "input", F.explode_outer(around).alias("form_no")).select(
        key, "form_no", (F.col("i") + 1).alias("input_no"), "input.type", "input.name", "input.id"
    )


def _targets(tokens: Column, tag: str, attr: str, url: Column) -> Column:
    values = F.transform(H.keep_tags(tokens, tag), lambda t: H.attribute(H.attributes(t), attr))
    return F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: U.join_url(url, v))


def _exploded_targets(pages, tag, attr, name, key, html, url) -> DataFrame:
    tokens = with_tokens(pages.select(key, url, html), html)
    found = tokens.select(key, F.posexplode_outer(_targets(F.col("tokens"), tag, attr, F.col(url))).alias("i", name))
    found = found.where("i IS NOT NULL")
    return found.select(key, (F.col("i") + 1).alias(f"{name}_no"), name)


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Resolved `<a href>` targets."""
    return _exploded_targets(pages, "a", "href", "link", key, html, url)


def page_scripts(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Resolved `<script src>` targets."""
    return _exploded_targets(pages, "script", "src", "script", key, html, url)


def _meta_entries(tokens: Column) -> Column:
    """array<struct<key, value>> with the last of equal keys kept; each tag is parsed once."""

    def entry(attrs: Column) -> Column:
        name = F.coalesce(
            F.nullif(H.attribute(attrs, "name"), F.lit("")), H.attribute(attrs, "http-equiv"), F.lit("")
        )
        return F.struct(
            F.lower(name).alias("key"),
            F.coalesce(H.attribute(attrs, "content"), F.lit("")).alias("value"),
        )

    parsed = F.transform(H.keep_tags(tokens, "meta"), H.attributes)
    return X.last_of_equal_keys(F.filter(F.transform(parsed, entry), lambda e: e["key"] != ""))


def page_meta(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per meta name: key, name, content."""
    tokens = with_tokens(pages.select(key, html), html)
    return tokens.select(key, F.explode_outer(_meta_entries(F.col("tokens"))).alias("e")).where("e IS NOT NULL").select(
        key, F.col("e.key").alias("name"), F.col("e.value").alias("content")
    )


def page_features(
    traffic: DataFrame, key: str = "request_id", body: str = "body", headers: str = "req_headers"
) -> DataFrame:
    """One nested row per request; `dom` is null unless the body is non-empty HTML."""
    ready = with_forms(with_tokens(html_pages(traffic, body, headers), "raw_body"))
    in_form = F.transform(
        "forms",
        lambda f: F.struct(
            f["action"].alias("action"),
            f["method"].alias("method"),
            f["action_host"].alias("action_host"),
            _plain_inputs(F.slice("inputs", f["from_input"] + 1, F.least(f["to_input"], F.size("inputs")) - f["from_input"])).alias("inputs"),
        ),
    )
    orphans = _plain_inputs(F.filter("inputs", lambda i: i["form_no"].isNull()))
    synthetic = F.array(
        F.struct(
            F.lit("").alias("action"), F.lit("get").alias("method"), F.lit("").alias("action_host"),
            orphans.alias("inputs"),
        )
    )
    dom = F.struct(
        H.title(F.col("live_html")).alias("page_title"),
        H.visible_text(F.col("live_html")).alias("all_text_content"),
        F.when(F.size(orphans) > 0, F.concat(in_form, synthetic)).otherwise(in_form).alias("forms"),
        _targets(F.col("tokens"), "a", "href", F.col("url")).alias("links"),
        _targets(F.col("tokens"), "script", "src", F.col("url")).alias("scripts"),
        F.map_from_entries(_meta_entries(F.col("tokens"))).alias("meta_tags"),
    )
    return ready.select(
        key,
        "url",
        U.host(F.col("url")).alias("host"),
        U.scheme(F.col("url")).alias("scheme"),
        X.lower_keys(F.col(headers)).alias("headers"),
        "is_html",
        F.coalesce("raw_body", F.lit("")).alias("raw_body"),
        F.when(F.col("raw_body").isNotNull(), dom).alias("dom"),
    )


def _plain_inputs(inputs: Column) -> Column:
    return F.transform(
        inputs,
        lambda i: F.struct(i["type"].alias("type"), i["name"].alias("name"), i["id"].alias("id")),
    )
