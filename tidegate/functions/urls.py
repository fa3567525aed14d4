"""URL, host and label expressions (regular expressions, because `parse_url` rejects odd hosts)."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions.text import bound
from tidegate.sources import dims

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
_REST = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H16 = r"[0-9a-fA-F]{1,4}"
_LS32 = rf"(?:{_H16}:{_H16}|{IPV4})"
IPV6 = (
    "(?:"
    rf"(?:{_H16}:){{6}}{_LS32}"
    rf"|::(?:{_H16}:){{5}}{_LS32}"
    rf"|(?:{_H16})?::(?:{_H16}:){{4}}{_LS32}"
    rf"|(?:(?:{_H16}:){{0,1}}{_H16})?::(?:{_H16}:){{3}}{_LS32}"
    rf"|(?:(?:{_H16}:){{0,2}}{_H16})?::(?:{_H16}:){{2}}{_LS32}"
    rf"|(?:(?:{_H16}:){{0,3}}{_H16})?::{_H16}:{_LS32}"
    rf"|(?:(?:{_H16}:){{0,4}}{_H16})?::{_LS32}"
    rf"|(?:(?:{_H16}:){{0,5}}{_H16})?::{_H16}"
    rf"|(?:(?:{_H16}:){{0,6}}{_H16})?::"
    r")(?:%[^%]+)?"
)

_PLAIN_SITE = r"^https?://[^/?#\s]+"
_PLAIN_PATH = r"^(?:/[^/?#\s]+)+/?(?:\?[^#\s]+)?(?:#\S+)?$"
_PLAIN_URL = r"^https?://[^/?#\s]+(?:/[^?#\s]*)?(?:\?[^#\s]+)?(?:#\S+)?$"

# Schemes whose references resolve against a base.
HIERARCHICAL = """
ftp http gopher nntp imap wais file https shttp mms prospero rtsp rtsps rtspu sftp svn svn+ssh ws wss
""".split()


def _prepared(url: Column) -> Column:
    """Leading control characters and inner line breaks do not belong to a URL."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_prepared(url), _SCHEME, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(_prepared(url), _AUTHORITY, 1)


def host(url: Column) -> Column:
    """Lower-case host without user, port and brackets; empty when there is none."""
    place = F.regexp_replace(authority(url), r"^.*@", "")
    bracketed = F.regexp_extract(place, r"^[^\[]*\[([^\]]*)", 1)
    return F.lower(
        F.when(F.contains(place, F.lit("[")), bracketed).otherwise(F.regexp_extract(place, r"^[^:]*", 0))
    )


def raw_path(url: Column) -> Column:
    return F.regexp_extract(_prepared(url), _REST, 1)


def path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(raw_path(url), r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(_prepared(url), r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(_prepared(url), r"^[^#]*#(.*)$", 1)


def strip_www(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"^www\.", "")


def is_ip(name: Column) -> Column:
    return name.rlike(rf"^(?:{IPV4}|{IPV6})$")


def is_loopback(name: Column) -> Column:
    bare = strip_www(name)
    return (bare == "localhost") | bare.rlike(
        rf"^127\.{_OCTET}\.{_OCTET}\.{_OCTET}$|^(?:0{{1,4}}:){{7}}0{{0,3}}1$|^::(?:0{{1,4}}:){{0,6}}0{{0,3}}1$"
    )


def domain_matches(name: Column, domain: Column) -> Column:
    """Equal to the domain or below it."""
    return (name == domain) | F.endswith(name, F.concat(F.lit("."), domain))


def among(col: Column, words: list[str]) -> Column:
    """Membership: a short list is one array literal, a long one a hash set."""
    if len(words) > 256:
        return col.isin(words)
    return F.array_contains(F.split(F.lit("\n".join(words)), "\n"), col)


def host_suffixes(name: Column, min_labels: int = 1) -> Column:
    """Every suffix of a host made of whole labels, longest first, down to `min_labels` labels."""
    parts = F.split(name, r"\.")
    count = F.size(parts) - (min_labels - 1)
    return F.when(
        count >= 1,
        F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")),
    ).otherwise(F.array().cast("array<string>"))


def host_tokens(name: Column) -> Column:
    return F.split(F.lower(name), r"[.\-_]+")


def sld_label(name: Column, suffixes: dims.SuffixList | list[str] | None = None) -> Column:
    """First label of the registrable domain; a bare suffix gives its first label.

    `suffixes` is a public suffix list with its `*.` and `!` entries (default: `dims.suffix_list()`). It is
    met from the end of the name: the top-level label leads to the entries below it, in which the suffixes of
    the name are looked up, the longest first.
    """
    known = dims.suffix_list() if suffixes is None else suffixes
    if not isinstance(known, dims.SuffixList):
        known = dims.SuffixList("given", tuple(known))
    tops = F.from_json(F.lit(json.dumps(known.by_top, ensure_ascii=False)), "map<string,string>")
    parts = F.split(name, r"\.")
    here = F.struct(F.try_element_at(tops, F.element_at(parts, -1)).alias("rules"), parts.alias("parts"), host_suffixes(name).alias("sizes"))

    def label(at: Column) -> Column:
        def listed(mark: str, text: Column) -> Column:
            return F.contains(at["rules"], F.concat(F.lit("|" + mark), text, F.lit("|")))

        def is_suffix(s: Column, i: Column) -> Column:
            below = (i > 0) & listed("!", F.get(at["sizes"], i - 1))
            wild = F.contains(s, F.lit(".")) & listed("*.", F.regexp_replace(s, r"^[^.]*\.", ""))
            return below | ((listed("", s) | wild) & ~listed("!", s))

        first = F.try_element_at(F.filter(at["sizes"], is_suffix), F.lit(1))
        labels = F.size(at["parts"])
        return F.get(at["parts"], F.greatest(labels - F.coalesce(F.size(F.split(first, r"\.")), F.lit(1)) - 1, F.lit(0)))

    return bound(here, label)


def normalize_confusables(name: Column) -> Column:
    text = F.lower(name)
    for lookalike, canonical in dims.MULTI_CHAR_CONFUSABLES:
        text = F.replace(text, F.lit(lookalike), F.lit(canonical))
    sources = "".join(s for s, _ in dims.CHAR_CONFUSABLES)
    targets = "".join(t for _, t in dims.CHAR_CONFUSABLES)
    return F.translate(text, sources, targets)


def is_typosquat(candidate: Column, target: Column) -> Column:
    """One edit apart, or two with equal ends; both at least three characters long."""
    gap = F.abs(F.length(candidate) - F.length(target))
    distance = F.levenshtein(candidate, target, 2)
    same_ends = (F.left(candidate, F.lit(1)) == F.left(target, F.lit(1))) & (
        F.right(candidate, F.lit(1)) == F.right(target, F.lit(1))
    )
    sized = (F.length(candidate) >= 3) & (F.length(target) >= 3) & (gap <= 2)
    return F.when(sized, (distance == 1) | ((distance == 2) & same_ends)).otherwise(F.lit(False))


def _remove_dots(segments: Column) -> Column:
    resolved = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    trailing = F.element_at(segments, F.lit(-1)).isin(".", "..")
    return F.when(trailing, F.array_append(resolved, F.lit(""))).otherwise(resolved)


def join_url(base: Column, reference: Column) -> Column:
    """Resolve a reference against a base URL."""
    ref = _prepared(reference)
    base_scheme, ref_scheme = scheme(base), scheme(ref)
    full_scheme = F.when(ref_scheme == "", base_scheme).otherwise(ref_scheme)
    foreign = (full_scheme != base_scheme) | ~full_scheme.isin(HIERARCHICAL)
    has_authority = ref.rlike(_AUTHORITY) & (authority(ref) != "")

    ref_path = raw_path(ref)
    base_parts = F.split(raw_path(base), "/")
    kept = F.when(
        F.element_at(base_parts, F.lit(-1)) != "", F.slice(base_parts, F.lit(1), F.size(base_parts) - 1)
    ).otherwise(base_parts)
    # Empty segments survive in an absolute path only.
    relative = F.concat(kept, F.split(ref_path, "/"))
    last = F.size(relative)
    tidy = F.filter(relative, lambda s, i: (i == 0) | (i == last - 1) | (s != ""))
    segments = F.when(ref_path.startswith("/"), F.split(ref_path, "/")).otherwise(tidy)
    dotted = F.exists(segments, lambda s: s.isin(".", ".."))
    merged = F.array_join(F.when(dotted, _remove_dots(segments)).otherwise(segments), "/")

    target_path = (
        F.when(has_authority, ref_path)
        .when(ref_path == "", raw_path(base))
        .when(merged == "", F.lit("/"))
        .otherwise(merged)
    )
    target_authority = F.when(has_authority, authority(ref)).otherwise(authority(base))
    own_query = F.when((ref_path == "") & ~has_authority & (query(ref) == ""), query(base)).otherwise(query(ref))
    slash = F.when((target_path != "") & ~target_path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    url = F.concat(
        full_scheme,
        F.lit("://"),
        target_authority,
        slash,
        target_path,
        F.when(own_query != "", F.concat(F.lit("?"), own_query)).otherwise(F.lit("")),
        F.when(fragment(ref) != "", F.concat(F.lit("#"), fragment(ref))).otherwise(F.lit("")),
    )
    # Most references are plain absolute paths or whole URLs; they skip the segment work.
    site = F.regexp_extract(base, _PLAIN_SITE, 0)
    plain_path = reference.rlike(_PLAIN_PATH) & ~F.contains(reference, F.lit("/.")) & (site != "")
    return (
        F.when(reference == "", base)
        .when(plain_path, F.concat(site, reference))
        .when(reference.rlike(_PLAIN_URL), reference)
        .when(foreign, reference)
        .otherwise(url)
    )


def joined_host(base: Column, reference: Column) -> Column:
    """Host of a resolved reference, without building the whole URL."""
    ref = _prepared(reference)
    base_scheme, ref_scheme = scheme(base), scheme(ref)
    full_scheme = F.when(ref_scheme == "", base_scheme).otherwise(ref_scheme)
    foreign = (full_scheme != base_scheme) | ~full_scheme.isin(HIERARCHICAL)
    return F.when((reference == "") | (~foreign & (authority(ref) == "")), host(base)).otherwise(host(ref))
