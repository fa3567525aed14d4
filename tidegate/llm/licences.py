"""Licence scans: identifier tags, notice phrases and licence expressions in texts.

One Aho-Corasick pass over the words of a text finds every notice phrase and every identifier tag. What
follows a tag is read from the text as a licence expression and evaluated by a shunting-yard parser.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tidegate.llm.common import id_and_text, map_texts

#: The base phrases and labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices, in words as the scan sees them.
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
TAG_IN_TEXT = re.compile(rb"spdx[\x00-\x2f\x3a-\x60\x7b-\x7f]+license[\x00-\x2f\x3a-\x60\x7b-\x7f]+identifier[ \t]*:?[ \t]*([^\r\n]*)", re.I)
#: Everything that cannot be in a word becomes a space, capital letters become small.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Licences a text may be kept under.
PERMITTED = frozenset("mit apache-2 apache-2.0 bsd-2-clause bsd-3-clause isc 0bsd cc0-1.0 unlicense cc-by-4.0 zlib".split())
RANK = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: `with` binds before `and`, `and` before `or`; None if the expression is not well formed.

    Operators are read in any case. Reading ends at the first token that cannot go on, so a comment's
    closing marks behind an expression do no harm.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in TOKEN.findall(expression):
        low = token.lower()
        if operand_next:
            if low == "(":
                stack.append(low)
            elif low == ")" or low in RANK:
                return None
            else:
                out.append(low)
                operand_next = False
        elif low in RANK:
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        elif low == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        else:
            break
    if operand_next:
        return None
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out


def evaluate(postfix: list[str], permitted: frozenset[str] = PERMITTED) -> tuple[set[str], bool]:
    """(licence ids named, whether the terms can be met with permitted licences only).

    `or` needs one side, `and` both; `with` adds an exception to a licence and keeps its verdict.
    """
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token not in RANK:
            stack.append(({token}, token.removesuffix("+") in permitted))
            continue
        (right, right_ok), (left, left_ok) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, left_ok))
        else:
            stack.append((left | right, left_ok or right_ok if token == "or" else left_ok and right_ok))
    return stack[0]


class Scanner:
    """The automaton over phrases and the tag, built once in each worker."""

    _automaton = None

    @classmethod
    def automaton(cls):
        if cls._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for phrase in [*BASE, *NOTICES, TAG]:
                made.add_word(f" {phrase} ", phrase)
            made.make_automaton()
            cls._automaton = made
        return cls._automaton

    @classmethod
    def scan(cls, text: str | None) -> dict:
        """What a text holds: numbers of words and base places, labels, expressions and their verdict."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.translate(TO_WORDS).split()
        joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
        starts, base, more, tagged = [], set(), set(), False
        spaces = counted = 0  # spaces before `counted`: hits come in the order of their ends
        for end, phrase in cls.automaton().iter(joined):
            if phrase in BASE:
                spaces, counted = spaces + joined.count(" ", counted, end), end
                starts.append(spaces - phrase.count(" ") - 1)
                base.add(BASE[phrase])
            elif phrase == TAG:
                tagged = True
            else:
                more.add(NOTICES[phrase])
        expressions, verdicts = [], []
        for found in TAG_IN_TEXT.finditer(raw) if tagged else ():
            expression = found[1].decode("utf-8", "replace").strip()
            postfix = to_postfix(expression)
            if postfix:
                ids, ok = evaluate(postfix)
                more |= ids
                expressions.append(expression)
                verdicts.append(ok)
        labels = base | more
        return {
            "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)),
            "score": 1.0 if expressions else 0.9 if labels else 0.5 if tagged else 0.0,
            "expressions": expressions,
            "permitted": all(verdicts) if verdicts else labels <= PERMITTED if labels else None,
        }


SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "expressions array<string>, permitted boolean"
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`_id` and the columns of `SCHEMA`) for every row, from the whole text.

    Words are runs of ASCII letters and digits and all other characters outside ASCII, ASCII letters
    lower-cased. A phrase is found wherever its words stand consecutively; places may overlap. `score`: 1
    with a well-formed expression behind a tag, 0.9 with a notice, 0.5 with a tag alone, else 0.
    `permitted`: whether all expressions (without any: all labels) allow the permitted licences; null
    without labels. Null and empty texts have no words and empty lists. Repeated rows are scanned each;
    other columns are not looked at; an empty table gives no rows.
    """

    def run(texts):
        made = [Scanner.scan(t) for t in texts]
        return {key: [m[key] for m in made] for key in made[0]} if made else {k.split()[0]: [] for k in SCHEMA.split(", ")}

    return map_texts(id_and_text(docs, id_col, text_col), SCHEMA, run)
