"""Conversation repair against brute force over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from tidegate.llm import convrepair, queries

SF = "/root/testdata/sf0.001"
STATES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute_damage(rows):
    """(conv, turn, role, text) of rows of a table -> the rows after damage, each conversation in order."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def ordered(kept):
    return sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def brute_report(kept):
    """The row of one conversation by trying all edits, with up to three inserts in a row."""
    faults, seen = [], set()
    for _, role, text in kept:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated")
        seen.add((role, text))

    @cache
    def best(i, state, inserts):
        options = []
        if inserts < 3:
            for initial in "ua":
                if (state, initial) in STATES:
                    cost, audit = best(i, STATES[state, initial], inserts + 1)
                    options.append((cost + 3, "I" + audit))
        if i == len(kept):
            if state in ("", "a"):
                options.append((0, ""))
            return min(options, default=(10**9, ""))
        cost, audit = best(i + 1, state, 0)
        options.append((cost + 4, "D" + audit))
        if faults[i] not in ("blank", "duplicate"):
            more = 3 * (faults[i] == "truncated")
            for edit, initial, price in (("K", kept[i][1][:1], 0), ("R", "u", 3), ("R", "a", 3)):
                if (state, initial) in STATES:
                    cost, audit = best(i + 1, STATES[state, initial], 0)
                    options.append((cost + price + more, edit + audit))
        return min(options)

    cost, audit = best(0, "", 0)
    rows, lines, state = iter(kept), [], ""
    for edit in audit:
        turn, role, text = (None, "", "") if edit == "I" else next(rows)
        if edit != "D":
            if edit != "K":
                role = "user" if (state, "u") in STATES else "assistant"
            state = STATES[state, role[0]]
            lines.append(f"{role}:{text}")
    turns = {t for t, _, _ in kept if t is not None}
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(kept, kept[1:]))
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {conv: brute_report(ordered(kept)) for conv, kept in brute_damage(rows).items()}
    got = queries.op11_conversations(spark, SF).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def noise(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "unknown"]
    texts = ["Yes.", "No", "Why?", " \t", "", None, "Go on!\n", "é…", "a. b", "1", "2.", "3.", "4.", "5!", "6?", "\x1c"]
    return [(rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("chunk_rows", [1, 3, 4096])
def test_random_conversations(spark, chunk_rows):
    """Odd roles and texts, ties in turns, null ids, and one conversation with most of the rows, in many chunks."""
    rng = random.Random(chunk_rows)
    rows = [(conv, *r, "x", "y") for conv in [None, *range(40)] for r in noise(rng, rng.randint(0, 7))] + [(7, *r, "x", "y") for r in noise(rng, 120)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, part string").repartition(5)
    want = {conv: brute_report(ordered_by_hash(spark, kept)) for conv, kept in brute_damage([r[:4] for r in rows]).items()}
    chunks = convrepair.repair(convrepair.damage(table), chunk_rows)
    got = convrepair.report(chunks).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    lines = convrepair.repaired_rows(chunks).orderBy("conv", "part", "number", "place").collect()
    assert "\n".join(f"{r['role']}:{r['text']}" for r in lines if r["conv"] == 7) and {r["role"][0] for r in lines} <= set("sua")


def ordered_by_hash(spark, kept):
    """Rows of one turn and role in the operator's order: by a hash of the text."""
    texts = sorted({r[2] for r in kept})
    hashed = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts] or [("",)], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    return sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashed[r[2]]))


def test_text_ids_long_texts_and_empty_tables(spark):
    rows = [("c", 1, "user", "word " * 500_000 + "."), ("c", 2, "assistant", "x" * 700_000 + "!"), ("d", None, None, None), (None, 5, "user", "a.")]
    table = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    want = {conv: brute_report(ordered(kept)) for conv, kept in brute_damage(rows).items()}
    assert {r["conv_id"]: tuple(r)[1:] for r in convrepair.report(convrepair.repair(convrepair.damage(table))).collect()} == want
    assert convrepair.report(convrepair.repair(convrepair.damage(table.limit(0)))).count() == 0


def test_vectors_converge():
    """Whatever vector a chunk starts from, a few ordinary rows lead to the same differences."""
    for signs in ("suaua", "uauaUa", "uDaBua"):
        starts = {tuple(convrepair.backward(signs * 3, end)[0][0]) for end in ((0, 0, 0, 0), convrepair.END, (0, 9, -3, 0), (0, 2, 5, 1))}
        assert len(starts) == 1
