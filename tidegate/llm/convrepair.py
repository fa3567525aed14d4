"""Conversation structure repair by a rank-convergence parallel Viterbi search.

A repair keeps, reroles or deletes rows and inserts empty ones, at the least cost, so that the initials of
the roles read `(s?(ua)+)?`. Four states follow that pattern: nothing yet, after s, after u, after a. The
cost from each state to the end is a vector; a row is a step back from one vector to the next. Only the
differences inside a vector decide anything, so vectors are kept less their first entry.

Rows are range-partitioned and sorted by conversation and turn, so a long conversation lies in several
partitions. Each task cuts its rows into chunks. A conversation inside one chunk is done there. The chunks
of the others all start at once from a speculative vector; fix-up passes hand each chunk the vector of the
next one and rerun those for which it differs by more than a constant, until none does. The stitched vectors
then drive a forward trace, from the state that the chunk before ends in, for the least audit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tidegate.llm.common import checkpoint, slices

#: A chunk ends at so many rows or characters.
CHUNK_ROWS = 4096
CHUNK_CHARS = 1 << 20
WHITE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The state behind the role that a state waits for: user, or assistant after a user.
EXPECTED = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}

Vector = tuple[int, int, int, int]


def _keep(state: int, initial: str) -> int | None:
    """The state behind a kept row, if the row may stand here."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return 2 if state != 2 else None
    return 3 if initial == "a" and state == 2 else None


def _with_inserts(costs: list[float]) -> list[float]:
    for _ in range(3):
        costs = [min(c, INSERT + costs[EXPECTED[s]]) for s, c in enumerate(costs)]
    return costs


#: Costs behind the last row: the pattern may end with nothing or after an assistant.
END: Vector = tuple(int(c) for c in _with_inserts([0, float("inf"), float("inf"), 0]))  # type: ignore[assignment]


@lru_cache(maxsize=100_000)
def step(sign: str, after: Vector) -> tuple[Vector, int]:
    """One row back: (the vector before it, less its first entry; that entry).

    Signs: B blank and D duplicate rows, which have to go; else the initial of the role (x: any other), as a
    capital if the text is truncated.
    """
    costs: list[float] = []
    for state in range(4):
        best = DELETE + after[state]
        if sign not in "BD":
            more = TRUNCATED if sign.isupper() else 0
            kept = _keep(state, sign.lower())
            if kept is not None:
                best = min(best, more + after[kept])
            best = min(best, REROLE + more + after[EXPECTED[state]])
        costs.append(best)
    costs = _with_inserts(costs)
    return tuple(int(c - costs[0]) for c in costs), int(costs[0])  # type: ignore[return-value]


def backward(signs: str, end: Vector = END) -> tuple[list[Vector], list[int]]:
    """Vectors before each row and behind the last, and what each row adds to the cost."""
    vectors, added = [end] * (len(signs) + 1), [0] * len(signs)
    for i in range(len(signs) - 1, -1, -1):
        end, added[i] = step(signs[i], end)
        vectors[i] = end
    return vectors, added


def trace(signs: str, vectors: list[Vector], added: list[int], state: int, last: bool) -> tuple[str, int]:
    """(the least of the cheapest edits from `state` on, the state behind them); `last` may insert at the end."""
    audit: list[str] = []
    for i, sign in enumerate(signs):
        before, after, base = vectors[i], vectors[i + 1], added[i]
        while True:
            cost = before[state] + base
            if DELETE + after[state] == cost:
                audit.append("D")
                break
            if INSERT + before[EXPECTED[state]] == before[state]:
                audit.append("I")
                state = EXPECTED[state]
                continue
            kept = _keep(state, sign.lower())
            if kept is not None and (TRUNCATED if sign.isupper() else 0) + after[kept] == cost:
                audit.append("K")
                state = kept
            else:
                audit.append("R")
                state = EXPECTED[state]
            break
    while last and state in (1, 2):
        audit.append("I")
        state = EXPECTED[state]
    return "".join(audit), state


@lru_cache(maxsize=50_000)
def _short(signs: str) -> tuple[int, str]:
    vectors, added = backward(signs)
    return sum(added), trace(signs, vectors, added, 0, True)[0]


def solve(signs: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation; short ones are remembered."""
    return _short(signs) if len(signs) <= 64 else _short.__wrapped__(signs)


def apply(audit: str, state: int, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The repaired rows (role, text)."""
    out, left = [], iter(rows)
    for edit in audit:
        if edit == "I":
            state = EXPECTED[state]
            out.append((ROLE[state], ""))
            continue
        role, text = next(left)
        if edit == "K":
            state = _keep(state, role[:1])
            out.append((role, text))
        elif edit == "R":
            state = EXPECTED[state]
            out.append((ROLE[state], text))
    return out


class Chunk:
    """Consecutive rows of one conversation, gathered in order."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []
        self.signs: list[str] = []
        self.seen: dict[tuple[str, str], int] = {}
        self.low = self.high = None
        self.turns = self.illegal = self.chars = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.rows and self.rows[-1][0][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        inner = text.rstrip(WHITE)
        row = (role, text)
        if not inner:
            sign = "B"
        elif row in self.seen:
            sign = "D"
        else:
            self.seen[row] = len(self.rows)
            sign = role[:1] if role[:1] in ("s", "u", "a") else "x"
            sign = sign if inner[-1] in ".!?" else sign.upper()
        self.rows.append(row)
        self.signs.append(sign)
        self.chars += len(text)

    def told(self, conv, part: int, number: int, open_: bool) -> dict:
        """A row of the chunk table: repaired if it is the whole conversation, else as it is."""
        signs = "".join(self.signs)
        row = {
            "conv": conv, "part": part, "number": number, "open": open_, "low": self.low, "high": self.high, "turns": self.turns,
            "illegal": self.illegal, "first": self.rows[0][0][:1] if self.rows else None, "last": self.rows[-1][0][:1] if self.rows else None,
            "signs": signs, "cost": None, "audit": None, "keys": None,
        }
        rows = self.rows
        if open_:
            row["keys"] = [{"at": i, "key": sha256(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass")).digest()} for (r, t), i in self.seen.items()]
        else:
            row["cost"], row["audit"] = solve(signs)
            rows = apply(row["audit"], 0, rows)
        row["lines"] = [{"role": r, "text": t} for r, t in rows]
        return row


LINES = "array<struct<role:string,text:string>>"
LINE_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
CHUNK = (
    "part int, number int, open boolean, low bigint, high bigint, turns bigint, illegal bigint, first string, last string, "
    f"signs string, cost bigint, audit string, keys array<struct<at:int,key:binary>>, lines {LINES}"
)


def _chunk_type(conv: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("conv", conv), ("part", pa.int32()), ("number", pa.int32()), ("open", pa.bool_()), ("low", pa.int64()), ("high", pa.int64()),
        ("turns", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("signs", pa.string()),
        ("cost", pa.int64()), ("audit", pa.string()), ("keys", pa.list_(pa.struct([("at", pa.int32()), ("key", pa.binary())]))),
        ("lines", LINE_TYPE),
    ])


def _cut(chunk_rows: int):
    """Sorted rows (conv, turn, role, text, dropped) -> chunk rows; what may go on elsewhere stays open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, size, shape = TaskContext.get().partitionId(), 0, [], 0, None
        started, now, chunk, runs, split = False, None, Chunk(), 0, False
        for batch in slices(batches):
            shape = shape or _chunk_type(batch.schema.field(0).type)
            for conv, turn, role, text, dropped in zip(*(c.to_pylist() for c in batch.columns)):
                full = len(chunk.rows) >= chunk_rows or chunk.chars >= CHUNK_CHARS
                if started and (conv != now or full):
                    split |= conv == now
                    out.append(chunk.told(now, part, number, split or runs == 0))
                    size, number, chunk = size + chunk.chars, number + 1, Chunk()
                    if conv != now:
                        runs, split = runs + 1, False
                    if len(out) >= 1000 or size >= CHUNK_CHARS:
                        yield pa.RecordBatch.from_pylist(out, shape)
                        out, size = [], 0
                started, now = True, conv
                if not dropped:
                    chunk.add(turn, role, text)
        if started:
            yield pa.RecordBatch.from_pylist([*out, chunk.told(now, part, number, True)], shape)

    return run


def _mapped(df: DataFrame, keep: list[str], take: list[str], made: str, types: list[pa.DataType], fn) -> DataFrame:
    """Columns `keep` unchanged beside the columns `made`, which `fn` makes of the values of `take`."""
    names = df.sparkSession.createDataFrame([], made).columns
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20):
            rows = [fn(*x) for x in zip(*(batch.column(len(keep) + i).to_pylist() for i in range(len(take))))]
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return df.select(*keep, *(F.col(c) for c in take)).mapInArrow(run, f"{kept}, {made}")


def _text(vector: Vector) -> str:
    return ",".join(map(str, vector))


def _vector(text: str) -> Vector:
    return tuple(map(int, text.split(",")))  # type: ignore[return-value]


def _rerun(signs: str, end: str) -> tuple[str, int]:
    vectors, added = backward(signs, _vector(end))
    return _text(vectors[0]), sum(added)


def _converged(chunks: DataFrame) -> DataFrame:
    """Open chunks (conv, part, number, signs) with `end`, the vector behind each, `last`, and its `cost`."""
    order = Window.partitionBy("conv").orderBy("part", "number")
    keep = ["conv", "part", "number", "signs", "end"]
    now = checkpoint(_mapped(chunks.withColumn("end", F.lit(_text(END))), keep, ["signs", "end"], "start string, cost bigint", [pa.string(), pa.int64()], _rerun))
    while True:
        told = now.withColumn("next", F.lead("start").over(order))
        told = told.select(*keep, "start", "cost", F.coalesce("next", F.lit(_text(END))).alias("want"), F.col("next").isNull().alias("last"))
        told = checkpoint(told)
        stale = told.where("`end` <> want")
        if stale.isEmpty():
            return told.select(*keep, "cost", "last")
        again = stale.select("conv", "part", "number", "signs", F.col("want").alias("end"))
        again = _mapped(again, keep, ["signs", "end"], "start string, cost bigint", [pa.string(), pa.int64()], _rerun)
        now = checkpoint(told.where("`end` = want").select(*keep, "start", "cost").union(again))


def _exits(signs: str, end: str, last: bool) -> tuple[str]:
    vectors, added = backward(signs, _vector(end))
    return ("".join(str(trace(signs, vectors, added, s, last)[1]) for s in range(4)),)


def _entered(chunks: DataFrame) -> DataFrame:
    """`chunks` with `state`, in which each is entered: passed on from chunk to chunk until nothing changes."""
    order = Window.partitionBy("conv").orderBy("part", "number")
    keep = ["conv", "part", "number", "signs", "end", "cost", "last"]
    now = _mapped(chunks, keep, ["signs", "end", "last"], "exits string", [pa.string()], _exits).withColumn("state", F.lit(0))
    now = checkpoint(now)
    while True:
        passed = F.lag(F.expr("cast(substring(exits, state + 1, 1) as int)")).over(order)
        told = checkpoint(now.withColumn("now", F.coalesce(passed, F.lit(0))))
        if told.where("state <> now").isEmpty():
            return told.select(*keep, "state")
        now = told.select(*keep, "exits", F.col("now").alias("state"))


def _traced(signs: str, end: str, last: bool, state: int, lines: list[dict]) -> tuple[str, list[dict]]:
    vectors, added = backward(signs, _vector(end))
    audit = trace(signs, vectors, added, state, last)[0]
    return audit, [{"role": r, "text": t} for r, t in apply(audit, state, [(x["role"], x["text"]) for x in lines])]


def _marked(signs: str, later: list[int] | None) -> tuple[str]:
    made = list(signs)
    for at in later or []:
        made[at] = "D"
    return ("".join(made),)


def _stitched(open_chunks: DataFrame) -> DataFrame:
    """Open chunks repaired: duplicates across chunks marked, vectors and states stitched, edits traced."""
    place = ["conv", "part", "number"]
    keys = open_chunks.select(*place, F.explode("keys").alias("k")).select(*place, "k.at", "k.key")
    earlier = F.row_number().over(Window.partitionBy("conv", "key").orderBy("part", "number"))
    later = keys.withColumn("nth", earlier).where("nth > 1").groupBy("part", "number").agg(F.collect_list("at").alias("later"))
    joined = open_chunks.select(*place, "signs").join(later, ["part", "number"], "left").select(*place, "signs", "later")
    signs = _mapped(joined, place, ["signs", "later"], "signs string", [pa.string()], _marked)
    solved = _entered(_converged(signs))
    solved = solved.select("part", "number", F.col("signs").alias("_signs"), F.col("end").alias("_end"), F.col("cost").alias("_cost"),
                           F.col("last").alias("_last"), F.col("state").alias("_state"))
    whole = open_chunks.drop("signs", "cost", "audit", "keys").join(solved, ["part", "number"])
    keep = ["conv", "part", "number", "open", "low", "high", "turns", "illegal", "first", "last", "_signs", "_cost"]
    made = _mapped(whole, keep, ["_signs", "_end", "_last", "_state", "lines"], f"audit string, lines {LINES}", [pa.string(), LINE_TYPE], _traced)
    return made.withColumnRenamed("_signs", "signs").withColumnRenamed("_cost", "cost")


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (`conv`, `turn`, `role`, `text`, `dropped`) with faults that crc32(`conv:turn`) mod 20 chooses: 0 drops
    a row (it stays as a mark of its conversation), 1 empties its text, 2 takes its `.!?` away, 3 repeats it,
    4 makes its role user. Null ids, turns, roles and texts read as one space; ids and turns stay null."""
    def said(name: str) -> Column:
        return F.coalesce(conversations[name].cast("string"), F.lit(" "))

    fault = F.pmod(F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")), F.lit(20)).cast("int")
    rows = conversations.select(
        conversations[conv_col].alias("conv"), conversations[turn_col].cast("long").alias("turn"), said(role_col).alias("role"),
        said(text_col).alias("text"), fault.alias("fault"),
    )
    text = F.when(F.col("fault") < 2, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(
        "conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fault") == 0).alias("dropped"), copies.alias("_copy"),
    ).drop("_copy")


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of repaired conversations, of rows (`conv`, `turn`, `role`, `text`, `dropped`) in order of turn.

    One row for each chunk: (`conv`, `part`, `number`) say its place, `signs` the faults found, `audit` the
    edits (Keep, Rerole, Delete, Insert), `lines` the repaired rows (role, text), `cost` its share; `low`,
    `high`, `turns`, `illegal`, `first`, `last` describe the rows before repair. Blank rows and rows whose
    role and text were seen earlier are deleted. A role is kept by its first letter alone; one that does not
    start with s, u or a cannot be kept. Rows of one turn are in order of role and text. Null roles and
    texts read as empty; null turns come first; null ids are one conversation; `dropped` rows only make
    their conversation appear. An empty table gives no rows.
    """
    rows = rows.select("conv", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "dropped")
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange("conv", "turn", "role", "_hash").sortWithinPartitions("conv", "turn", "role", "_hash", "text")
    conv = rows.schema["conv"].dataType.simpleString()
    cut = dealt.drop("_hash").mapInArrow(_cut(chunk_rows), f"conv {conv}, {CHUNK}")
    cut = checkpoint(cut)
    done = cut.where("not open").drop("keys")
    return done.unionByName(_stitched(cut.where("open")).select(done.columns))


def repaired_rows(chunks: DataFrame) -> DataFrame:
    """(`conv`, `part`, `number`, `place`, `role`, `text`): the repaired rows, in order of the middle three."""
    return chunks.select("conv", "part", "number", F.posexplode("lines").alias("place", "line")).select("conv", "part", "number", "place", "line.role", "line.text")


def _digests(chunks: DataFrame, conv: DataType) -> DataFrame:
    """(conv, repaired_sha256) of open conversations: their chunks pass one by one, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, now, state, any_, shape = False, None, None, False, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], shape), pa.array([state.hexdigest()])], names=["conv", "repaired_sha256"])

        for batch in slices(batches, 20):
            shape = batch.schema.field(0).type
            for who, text, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not started or who != now:
                    if started:
                        yield told()
                    started, now, state, any_ = True, who, sha256(), False
                if n:
                    state.update(("\n" * any_ + text).encode("utf-8", "surrogatepass"))
                    any_ = True
        if started:
            yield told()

    rows = chunks.select("conv", _joined(F.col("lines")).alias("t"), F.size("lines").alias("n"), "part", "number")
    rows = rows.repartition("conv").sortWithinPartitions("conv", "part", "number")
    return rows.mapInArrow(run, f"conv {conv.simpleString()}, repaired_sha256 string")


def _joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")


def report(chunks: DataFrame) -> DataFrame:
    """One row for each conversation: (`conv_id`, `gaps`, `blank`, `duplicate`, `truncated`, `illegal`, `cost`,
    `audit`, `repaired_sha256`), from the chunks of `repair`.

    `gaps` are turns missing between the first and the last one; `illegal` counts neighbours whose initials
    are not su, ua or au, before repair. The hash is over `role:text` lines; where a conversation has
    several chunks, they pass through one task in order, one at a time.
    """
    chunks = chunks.select(
        "*", *((F.length("signs") - F.length(F.regexp_replace("signs", marks, ""))).cast("long").alias(name)
               for name, marks in (("blank", "B"), ("duplicate", "D"), ("truncated", "[SUAX]")))
    )
    gap = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    whole = chunks.where("not open").select(
        F.col("conv").alias("conv_id"), gap.alias("gaps"), *names[1:-1], F.sha2(_joined(F.col("lines")).cast("binary"), 256).alias("repaired_sha256")
    )
    parts = checkpoint(chunks.where("open"))
    order = Window.partitionBy("conv").orderBy("part", "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "*", F.last("high", True).over(before).alias("_high"), F.last("last", True).over(before).alias("_last"),
        F.col("first").isNotNull().alias("_any"),
    )
    pair = F.concat("_last", "first")
    thin = parts.select(
        "conv", "part", "number", "low", "high", *names[1:4], "cost", "audit",
        (F.col("turns") - F.coalesce((F.col("_high") == F.col("low")).cast("long"), F.lit(0))).alias("turns"),
        (F.col("illegal") + F.when(pair.isNotNull() & ~pair.isin(*LEGAL), 1).otherwise(0)).alias("illegal"),
    )
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "number", "audit"))), lambda x: x["audit"]), "")
    sums = thin.groupBy("conv").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"),
        *(F.sum(c).alias(c) for c in (*names[1:5], "cost")), audit.alias("audit"),
    )
    hashes = _digests(parts, chunks.schema["conv"].dataType).withColumnRenamed("conv", "_conv")
    open_ = sums.join(hashes, F.col("conv").eqNullSafe(F.col("_conv"))).select(F.col("conv").alias("conv_id"), gap.alias("gaps"), *names[1:])
    return whole.unionByName(open_)
