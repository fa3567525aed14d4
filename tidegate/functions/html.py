"""HTML expressions: everything works inside one row, so page bodies are never shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions.text import decode_entities, strip
from tidegate.sources import dims

# Comments, and the bodies of scripts and styles, found left to right. The replacement leaves
# `<!>` as a mark, so that text on both sides stays apart, and keeps the opening tag.
_INERT = (
    r"(?is)(?=<[!s])(?:<!--.*?-->"
    r"|(<script\b[^>]*>).*?(?:</script\s*>|\z)"
    r"|(<style\b[^>]*>).*?(?:</style\s*>|\z))"
)
_INERT_KEPT = "<!>$1$2"

# One tag. Quotes count only in attribute values. The possessive loops keep the matcher's stack flat.
TAG = (
    r"""<(?:/[a-zA-Z][^>]*+|[a-zA-Z][^\s/>]*+"""
    r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=++\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)*+)>"""
)
_MARKUP = TAG + r"|<[!?][^>]*+>"
_ATTRIBUTE = r"""[^\s/>=][^\s/>=]*(?:\s*=+\s*(?:"[^"]*"|'[^']*'|(?!["'])[^\s>]*))?"""
_TITLE = r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|\z)"

SENSITIVE_NAME = "(?iU)" + dims.SENSITIVE_NAME_PATTERN


def decoded_body(body: Column, binary: bool = False, max_bytes: int | None = None) -> Column:
    """Page text, whole or of its first `max_bytes` bytes, with broken characters replaced."""
    if max_bytes is None:
        return F.make_valid_utf8(body.cast("string")) if binary else body
    data = body if binary else F.encode(body, "utf-8")
    cut = F.make_valid_utf8(F.substring(data, 1, max_bytes).cast("string"))
    if binary:
        return cut
    return F.when(F.octet_length(body) <= max_bytes, body).otherwise(cut)


def without_inert(html: Column) -> Column:
    return F.regexp_replace(html, _INERT, _INERT_KEPT)


def tag_tokens(live_html: Column) -> Column:
    """Raw tags in document order."""
    return F.regexp_extract_all(live_html, F.lit(TAG), F.lit(0))


def tag_name(raw: Column) -> Column:
    return F.lower(F.regexp_extract(raw, r"^</?([a-zA-Z][^\s/>]*)", 1))


def keep_tags(tokens: Column, *names: str) -> Column:
    return F.filter(tokens, lambda t: t.rlike(rf"(?i)^<(?:{'|'.join(names)})(?=[\s/>])"))


def attributes(raw: Column) -> Column:
    """array<struct<name, value>> of an opening tag, in order; a bare attribute has an empty value."""

    def pair(a: Column) -> Column:
        value = F.regexp_extract(a, r"(?s)^[^\s=]+\s*=+\s*(.*)$", 1)
        bare = F.regexp_replace(value, r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2")
        return F.struct(
            F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)).alias("name"),
            decode_entities(bare, attribute=True).alias("value"),
        )

    rest = F.regexp_replace(raw, r"^<[a-zA-Z][^\s/>]*|>$", "")
    return F.transform(F.regexp_extract_all(rest, F.lit(_ATTRIBUTE), F.lit(0)), pair)


def attribute(attrs: Column, name: str) -> Column:
    """Value of the last attribute of that name, null when absent."""
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(-1))["value"]


def title(live_html: Column) -> Column:
    """Text of the first title."""
    inner = F.split(F.regexp_extract(live_html, _TITLE, 1), _MARKUP)
    return F.array_join(F.transform(inner, lambda p: strip(decode_entities(p))), "")


def visible_text(live_html: Column) -> Column:
    """All text nodes, stripped, without the empty ones, joined by a space."""
    pieces = F.transform(F.split(live_html, _MARKUP), lambda p: strip(decode_entities(p)))
    return F.array_join(F.filter(pieces, lambda p: p != ""), " ")


# Elements that never hold others. The bodies of scripts and styles are gone already,
# with their closing tags.
VOID = "area base basefont bgsound br col command embed frame hr image img isindex link meta param source track wbr".split()
_NOT_NESTING = rf"(?i)^<(?:{'|'.join([*VOID, 'keygen', 'menuitem', 'nextid', 'spacer', 'script', 'style'])})(?=[\s/>])"
_CLOSED_AT_ONCE = r"""["'\s]/\s*>$|^<[a-zA-Z][^\s/>]*/>$"""
_FORM_OR_INPUT = r"(?i)^<(?:form|input)(?=[\s/>])"


_ENTRIES_PER_BLOCK = 256


def nest_forms(tokens: Column) -> Column:
    """Form nesting, from the tags of a page in document order.

    Returns array<struct<kind, form_no, pos, inputs, raw>> with one `open` and at most one `close` entry per
    form and one `input` entry per input (its innermost form, or null); `inputs` counts the inputs before.
    An input lies in every form whose entries enclose it. A closing tag ends everything down to the nearest open element of its
    name, forms included, and is ignored where there is none; `<form/>` is empty.
    """
    entry = "struct<kind:string,form_no:int,pos:int,inputs:int,raw:string>"
    relevant = F.filter(
        tokens, lambda t: t.rlike(_FORM_OR_INPUT) | ~(t.rlike(_NOT_NESTING) | t.rlike(_CLOSED_AT_ONCE))
    )
    # `stack` is the text of the open elements, innermost first, such as `<form><div><body>`.
    start = F.struct(
        F.lit("").alias("stack"),
        F.array().cast("array<int>").alias("open"),
        F.lit(0).alias("seen"),
        F.lit(0).alias("pos"),
        F.lit(0).alias("inputs"),
        F.array().cast(f"array<{entry}>").alias("found"),
        F.array().cast(f"array<array<{entry}>>").alias("blocks"),
    )
    none_found = F.array().cast(f"array<{entry}>")

    def step(acc: Column, raw: Column) -> Column:
        stack, open_, seen, pos, inputs = (acc[n] for n in ("stack", "open", "seen", "pos", "inputs"))
        # Appending copies an array, so entries are gathered in blocks and the work follows the page.
        full = F.size(acc["found"]) >= _ENTRIES_PER_BLOCK
        found = F.when(full, none_found).otherwise(acc["found"])
        blocks = F.when(full, F.array_append(acc["blocks"], acc["found"])).otherwise(acc["blocks"])

        def as_entry(kind: str, form_no: Column) -> Column:
            return F.struct(
                F.lit(kind).alias("kind"), form_no.alias("form_no"), pos.alias("pos"), inputs.alias("inputs"), raw.alias("raw")
            )

        def next_state(stack=stack, open_=open_, seen=seen, found=found, inputs=inputs) -> Column:
            return F.struct(
                stack.alias("stack"), open_.alias("open"), seen.alias("seen"), (pos + 1).alias("pos"),
                inputs.alias("inputs"), found.alias("found"), blocks.alias("blocks"),
            )

        name = tag_name(raw)
        here = F.concat(F.lit("<"), name, F.lit(">"))
        at = F.instr(stack, here)
        popped = F.left(stack, at + F.length(here) - 1)
        rest = F.substring(stack, at + F.length(here), F.length(stack))
        ended = F.size(F.split(popped, "<form>")) - 1
        kept = F.size(open_) - ended
        ends = F.transform(
            F.reverse(F.slice(open_, kept + 1, ended)), lambda n: as_entry("close", n)
        )
        number = seen + 1
        opened = F.array_append(found, as_entry("open", number))
        return (
            F.when(
                raw.startswith("</"),
                F.when(at == 0, next_state())
                .when(F.contains(popped, F.lit("<form>")), next_state(
                    stack=rest, open_=F.slice(open_, F.lit(1), kept), found=F.concat(found, ends)
                ))
                .otherwise(next_state(stack=rest)),
            )
            .when(name == "input", next_state(
                found=F.array_append(found, as_entry("input", F.try_element_at(open_, F.lit(-1)))), inputs=inputs + 1
            ))
            .when(name != "form", next_state(stack=F.concat(here, stack)))
            .when(raw.rlike(_CLOSED_AT_ONCE), next_state(
                seen=number, found=F.array_append(opened, as_entry("close", number))
            ))
            .otherwise(next_state(
                stack=F.concat(here, stack), open_=F.array_append(open_, number), seen=number, found=opened
            ))
        )

    return F.aggregate(relevant, start, step, lambda acc: F.concat(F.flatten(acc["blocks"]), acc["found"]))


def is_sensitive(kind: Column, name: Column, ident: Column) -> Column:
    return kind.isin(dims.SENSITIVE_INPUT_TYPES) | F.concat_ws(" ", name, ident).rlike(SENSITIVE_NAME)
