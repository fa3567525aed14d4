"""String, header and time expressions."""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.sources import dims

# Characters a strip removes: the Unicode white space class.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0         "
    "       　"
)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def clean_string(col: Column, max_length: int | None = None) -> Column:
    """Stripped text; null when blank or longer than `max_length`."""
    text = strip(col)
    ok = text != ""
    if max_length is not None:
        ok = ok & (F.length(text) <= max_length)
    return F.when(ok, text)


def bounded_float(col: Column, minimum: float | None = None, maximum: float | None = None) -> Column:
    """Finite number within the bounds, else null; text that reads as a number counts."""
    number = col.try_cast("double")
    ok = ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    if minimum is not None:
        ok = ok & (number >= minimum)
    if maximum is not None:
        ok = ok & (number <= maximum)
    return F.when(ok, number)


def positive_int(col: Column) -> Column:
    number = col.try_cast("long")
    return F.when(number >= 1, number)


_ISO = (
    r"^(\d{4}-\d{2}-\d{2})"
    r"(?:[T ](\d{2})(?::(\d{2})(?::(\d{2}(?:[.,]\d+)?))?)?(Z|[+-]\d{2}:?\d{2})?)?$"
)
#: Of these the ones with seconds and an offset, which a cast reads as they are.
_WHOLE_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"


def parse_iso(col: Column) -> Column:
    """ISO-8601 text to a timestamp; text without an offset is UTC, bad text is null."""
    text = strip(col)

    def part(group: int, default: str) -> Column:
        found = F.regexp_extract(text, _ISO, group)
        return F.when(found == "", F.lit(default)).otherwise(found)

    offset = F.regexp_replace(F.replace(part(5, "Z"), F.lit("Z"), F.lit("+00:00")), r"^(...)(\d\d)$", "$1:$2")
    full = F.concat(
        part(1, ""), F.lit("T"), part(2, "00"), F.lit(":"), part(3, "00"), F.lit(":"),
        F.translate(part(4, "00"), ",", "."), offset,
    )
    return F.when(text.rlike(_WHOLE_ISO), F.try_to_timestamp(text)).when(text.rlike(_ISO), F.try_to_timestamp(full))


def iso_z(col: Column) -> Column:
    """UTC text to the second, with `Z`."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def guard_action(decision: Column) -> Column:
    return F.initcap(decision)


def display_weight(weight: Column) -> Column:
    return F.round(weight, 4)


def clean_agent(col: Column) -> Column:
    """Agent name as stored: letters, digits and `._ -`, at most 20 characters, with a default."""
    kept = F.regexp_replace(strip(col), r"[^\p{L}\p{N}._ \-]", "")
    return F.coalesce(F.nullif(F.left(kept, F.lit(20)), F.lit("")), F.lit(dims.DEFAULT_AGENT))


def bound(value: Column, build: Callable[[Column], Column]) -> Column:
    """`build` over `value`, which is evaluated once however often it is named."""
    return F.transform(F.array(value), build)[0]


def last_of_equal_keys(entries: Column) -> Column:
    """Of array<struct<key, value>> the entries without a later one of their key, in order; sorted, not searched."""
    placed = F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e["value"].alias("value")))

    def latest(ordered: Column) -> Column:
        return F.filter(ordered, lambda e, i: F.coalesce(~F.get(ordered, i + 1)["key"].eqNullSafe(e["key"]), F.lit(True)))

    back = F.transform(bound(F.array_sort(placed), latest), lambda e: F.struct(e["at"].alias("at"), e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(F.array_sort(back), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def lower_keys(headers: Column) -> Column:
    """Headers with lower-case names; of names that collide, the last one is kept."""
    entries = F.transform(
        F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
    )
    return F.map_from_entries(last_of_equal_keys(entries))


def header(headers: Column, name: str) -> Column:
    """Header value by case-insensitive name, empty when absent."""
    hits = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit(""))


#: Request headers that name the agent, by precedence.
AGENT_HEADERS = ("x-agent-name",)


def agent_from_headers(headers: Column, names: tuple[str, ...] = AGENT_HEADERS) -> Column:
    """First non-empty agent header, by order of `names`; null when the value is blank."""
    first = F.coalesce(*[F.nullif(header(headers, n.lower()), F.lit("")) for n in names])
    return F.when(strip(first) != "", first)


def encode_headers(headers: Column) -> Column:
    """JSON object text with sorted names."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(headers))))


def decode_headers(text: Column) -> Column:
    """JSON object text to a map; null when the text is not such an object."""
    return F.from_json(text, "map<string,string>")


@lru_cache(maxsize=1)
def _names_json() -> str:
    """All names of HTML 5 with and without their semicolon, from the standard library's table, below their first
    two characters; those of common names first."""
    levels: dict[str, dict[str, str]] = {start: {} for start in ("am", "nb", "lt", "gt", "qu", "ap")}
    for name, chars in html.entities.html5.items():
        levels.setdefault(name[:2], {})[name] = chars
    return json.dumps(levels, ensure_ascii=False)


def _names_at(piece: Column) -> Column:
    """The names that start like `piece`, with their characters; null if there are none."""
    return F.try_element_at(F.from_json(F.lit(_names_json()), "map<string,map<string,string>>"), F.left(piece, F.lit(2)))


# What a number from 0x80 on means in pages, U+FFFD where a byte has no character.
C1_CHARACTERS = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_NUMBER = r"^#(?:[xX]0*([0-9a-fA-F]*)|0*([0-9]*))"


def _char_of_number(piece: Column, attribute: bool) -> Column:
    """The character of a numeric reference of any length; the ones that are none give U+FFFD or, in an attribute,
    nothing where the standard says so."""
    hexed, decimal = F.regexp_extract(piece, _NUMBER, 1), F.regexp_extract(piece, _NUMBER, 2)
    big = (F.length(hexed) > 6) | (F.length(decimal) > 7)
    code = F.when(big, 0x110000).otherwise(
        F.when(piece.rlike("^#[xX]"), F.conv(F.nullif(hexed, F.lit("")), 16, 10)).otherwise(F.nullif(decimal, F.lit(""))).cast("int")
    )
    code = F.coalesce(code, F.lit(0))
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    lost = (code > 0x10FFFF) | code.between(0xD800, 0xDFFF) | (code == 0 if attribute else F.lit(False))
    named = F.when(lost, F.lit("\ufffd")).when(
        code.between(0x80, 0x9F), F.substring(F.lit(C1_CHARACTERS), code - 0x7F, F.lit(1))
    )
    if attribute:
        gone = code.between(1, 8) | (code == 0x0B) | code.between(0x0E, 0x1F) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF)
        named = named.when(gone | ((code % 0x10000) >= 0xFFFE), F.lit(""))
    return named.otherwise(char)


def _page_reference(p: Column) -> Column:
    """What follows an ampersand in page text: a name counts as a whole, with its semicolon or without; an unknown
    one loses the semicolon, as the page parser hands it on."""
    name = F.regexp_extract(p, r"^[a-zA-Z][-.a-zA-Z0-9]*", 0)
    number = F.regexp_extract(p, r"^#(?:[xX][0-9a-fA-F]+|[0-9]++(?![a-fA-F]))", 0)
    char = F.try_element_at(_names_at(p), F.concat(name, F.lit(";")))

    def rest(head: Column) -> Column:
        left = _after(p, head)
        return F.when(left.startswith(";"), F.substring(left, F.lit(2), F.length(left))).otherwise(left)

    return (
        F.when(number != "", F.concat(_char_of_number(p, False), rest(number)))
        .when(name == "", F.concat(F.lit("&"), p))
        .otherwise(F.concat(F.coalesce(char, F.concat(F.lit("&"), name)), rest(name)))
    )


def _attribute_reference(p: Column) -> Column:
    """What follows an ampersand in an attribute: the longest name that it starts with counts."""
    number = F.regexp_extract(p, r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", 0)

    def named(names: Column) -> Column:
        fits = F.filter(F.map_keys(names), lambda k: F.startswith(p, k))
        longest = F.aggregate(fits, F.lit(""), lambda best, k: F.when(F.length(k) > F.length(best), k).otherwise(best))
        return bound(longest, lambda k: F.when(k != "", F.concat(F.try_element_at(names, k), _after(p, k))))

    char = F.when(number != "", F.concat(_char_of_number(p, True), _after(p, number))).otherwise(bound(_names_at(p), named))
    return F.coalesce(char, F.concat(F.lit("&"), p))


def decode_entities(text: Column, attribute: bool = False) -> Column:
    """Character references of HTML 5 in one pass: in page text as the page parser reads them, in an attribute as
    the standard has it (`html.unescape`)."""
    parts = F.split(text, "&")
    piece = _attribute_reference if attribute else _page_reference
    decoded = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), ""))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def _after(text: Column, head: Column) -> Column:
    return F.substring(text, F.length(head) + 1, F.length(text))
