"""Order MinHash fingerprints: sensitive to which word k-mers a text has and to their order.

Every k-mer gets the number of its occurrence, so repeats count. The hash of (k-mer, occurrence) puts it
into one of `DRAWS` draws; in each draw the two smallest are selected, put in the order they have in the
text, and hashed as a tuple. The likeness of two fingerprints is the share of draws with equal tuples.
Everything is array functions inside the row of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import id_and_text

K = 3
DRAW_BITS = 6
DRAWS = 1 << DRAW_BITS
#: Bits of a text position, and of a hash that is sorted together with one.
PLACE_BITS = 24
HASH_BITS = 62 - PLACE_BITS
DIGITS = 4
#: Documents of a block in which each meets the next one.
BLOCK_ROWS = 2000


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def signature(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """Adds column `name`: `DRAWS` longs, -1 for a draw without k-mers. Drops no column.

    Each step is a projection of its own, so that no step is worked out twice.
    """
    w, s, o, m = (f"{name}_{x}" for x in "wsom")
    place_mask = F.lit((1 << PLACE_BITS) - 1)
    df = df.withColumn(w, F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\\s+"), lambda x: F.when(x != "", F.xxhash64(x))))
    df = df.withColumn(w, F.filter(w, lambda x: x.isNotNull()))
    hashed = lambda x, i: F.xxhash64(x, *(F.get(F.col(w), i + j) for j in range(1, k)))
    first = F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.least(F.size(w), F.lit(1))))
    packed = lambda x, i: F.shiftleft(_low(hashed(x, i), HASH_BITS), PLACE_BITS).bitwiseOR(F.least(i, place_mask).cast("long"))
    df = df.withColumn(s, F.array_sort(F.transform(first, packed)))

    def same(i: Column, j: Column) -> Column:
        """Whether the k-mer j places before place i is the same one."""
        return F.coalesce(F.shiftright(F.get(F.col(s), i - j), PLACE_BITS) == F.shiftright(F.get(F.col(s), i), PLACE_BITS), F.lit(False))

    steps = F.array(*(F.lit(1 << b) for b in range(PLACE_BITS - 1, -1, -1)))

    def numbered(x: Column, i: Column) -> Column:
        occurrence = F.when(same(i, F.lit(1)), F.aggregate(steps, F.lit(0), lambda n, b: F.when(same(i, n + b), n + b).otherwise(n))).otherwise(0)
        h = F.xxhash64(F.shiftright(x, PLACE_BITS), occurrence)
        return F.shiftleft(_low(h, HASH_BITS), PLACE_BITS).bitwiseOR(_low(x, PLACE_BITS))

    df = df.withColumn(o, F.array_sort(F.transform(s, numbered)))
    draw = lambda x: F.shiftright(x, 62 - DRAW_BITS)
    df = df.withColumn(m, F.filter(o, lambda x, i: (i < 2) | (draw(F.get(F.col(o), i - 2)) != draw(x))))

    def pair(x: Column, i: Column) -> Column:
        """The tuple that begins a draw: its one or two k-mers in the order of the text."""
        other = F.get(F.col(m), i + 1)
        h, g = F.shiftright(x, PLACE_BITS), F.shiftright(other, PLACE_BITS)
        both = F.when(_low(x, PLACE_BITS) <= _low(other, PLACE_BITS), F.xxhash64(h, g)).otherwise(F.xxhash64(g, h))
        value = F.when(draw(x) == draw(other), both).otherwise(F.xxhash64(h))
        begins = (i == 0) | (draw(F.get(F.col(m), i - 1)) != draw(x))
        return F.when(begins, F.struct(draw(x).cast("int").alias("d"), _low(value, 4 * DIGITS).alias("v")))

    found = F.map_from_entries(F.filter(F.transform(m, pair), lambda e: e.isNotNull()))
    df = df.withColumn(m, found)
    draws, none = F.array(*(F.lit(d) for d in range(DRAWS))), F.lit(-1).cast("long")
    filled = F.transform(draws, lambda d: F.coalesce(F.try_element_at(F.col(m), d), none))
    df = df.withColumn(name, F.when(F.size(m) > 0, filled).otherwise(F.array_repeat(none, DRAWS)))
    return df.drop(w, s, o, m)


def text_of(signature_: Column) -> Column:
    """A signature as text: four hex digits for each draw, dots for a draw without k-mers."""
    return F.array_join(F.transform(signature_, lambda v: F.when(v < 0, "." * DIGITS).otherwise(F.lpad(F.lower(F.hex(v)), DIGITS, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of draws with equal tuples among those that either has; 1 where neither has any."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x >= 0)), lambda e: e))
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x >= 0) | (y >= 0)), lambda e: e))
    return F.when(used == 0, 1.0).otherwise(equal / F.greatest(used, F.lit(1)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(`_id`, `_text`, `_sig`) for every row: null and empty texts have no k-mers and a signature of -1.

    Equal texts have equal signatures. Repeated rows are done each; other columns are not looked at; an
    empty table gives no rows.
    """
    return signature(id_and_text(docs, id_col, text_col), "_text", "_sig", k)


def in_blocks(ids: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[Column, list]:
    """(block of `_id`, smallest `_id` of each block from the second on).

    Quantiles of the ids bound blocks of about `block_rows` rows; the block is found by halving. A repeated
    id is in one block; null ids are in block 0.
    """
    n = ids.count()
    parts = max(1, min(1 << 16, n // block_rows))
    cuts = ids.agg(F.percentile_approx("_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    bounds = sorted(set(cuts or []))
    if not bounds:
        return F.lit(0), []
    table = F.array(*(F.lit(b) for b in bounds))
    descend = F.array(*(F.lit(1 << b) for b in range(len(bounds).bit_length() - 1, -1, -1)))
    below = lambda at: F.coalesce(F.get(table, at - 1) <= F.col("_id"), F.lit(False))
    block = F.aggregate(descend, F.lit(0), lambda at, b: F.when(below(at + b), at + b).otherwise(at))
    return block, bounds


def with_next(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds `_next`, a struct of the other columns of the row that follows in ascending `_id`.

    After the last row comes the first. The first rows of a block (those of its smallest id) also go to the
    block before, so that each block finds its next rows alone and every other row is shuffled once. Null
    ids come first; rows of one id follow each other in the order of their texts. A single row is its own
    next.
    """
    block, bounds = in_blocks(rows.select("_id"), block_rows)
    last = len(bounds)
    columns = rows.columns
    first_id = F.col("_id") == F.get(F.array(*(F.lit(b) for b in bounds)), F.col("_block") - 1) if bounds else F.lit(False)
    low = rows.agg(F.min("_id"), F.count("*") - F.count("_id")).first()
    starts = F.col("_id").isNull() if low[1] else F.col("_id").eqNullSafe(F.lit(low[0]))
    placed = rows.withColumn("_block", block)
    copies = F.filter(
        F.array(
            F.struct(F.col("_block").alias("b"), F.lit(0).alias("c")),
            F.when(F.coalesce(first_id, F.lit(False)), F.struct((F.col("_block") - 1).alias("b"), F.lit(1).alias("c"))),
            F.when(starts, F.struct(F.lit(last).alias("b"), F.lit(2).alias("c"))),
        ),
        lambda c: c.isNotNull(),
    )
    spread = placed.select(*columns, F.explode(copies).alias("_copy")).select(*columns, F.col("_copy.b").alias("_at"), F.col("_copy.c").alias("_kind"))
    order = Window.partitionBy("_at").orderBy("_kind", F.col("_id").asc_nulls_first(), "_text")
    following = F.lead(F.struct(*columns)).over(order)
    return spread.withColumn("_next", following).where("_kind = 0").drop("_at", "_kind")


def neighbour_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(`_id`, `_sig`, `_edited`, `_edited_sig`, `_next_sig`, `n_chars`) for every row.

    The edited text keeps all but the last half of the code points (rounded down) and goes on with the
    first as many, or all, of the next document. Null texts count as empty.
    """
    rows = fingerprints(docs.select(docs[id_col], F.coalesce(docs[text_col].cast("string"), F.lit("")).alias(text_col)), id_col, text_col, k)
    paired = with_next(rows).withColumn("n_chars", F.char_length("_text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("_next._text"), F.lit(1), half))
    paired = paired.select("_id", "_sig", F.col("_next._sig").alias("_next_sig"), "n_chars", edited.alias("_edited"))
    return signature(paired, "_edited", "_edited_sig", k)
