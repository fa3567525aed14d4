"""SimHash near-duplicates, found with BK-trees over shards of the fingerprints.

Two fingerprints that differ in at most `radius` bits agree in at least `agree` of `radius + agree`
blocks of bits. Every choice of `agree` blocks with their values names a shard; so a pair within the
radius always shares a shard, and no pair is lost. Each shard's fingerprints form BK-trees of at most
about `TREE_SIZE` nodes; a larger shard has several, and its fingerprints go to each of them by key.
Trees travel by shard key through a shuffle: a driver broadcast would gather every fingerprint there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import checkpoint, id_and_text, map_texts
from tidegate.llm.graph import components

BITS = 64
MASK = (1 << BITS) - 1
SEED = 42
TREE_SIZE = 4096
SHARD_MEAN = 64
#: Row b has the bits of byte b, lowest first.
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def simhash(text: str | None, words: int = 4) -> int:
    """The fingerprint of a whole text as a signed 64-bit number; zero where there are no words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if n == 0:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if n <= words:
        value = digest(joined, SEED)
        return value - (1 << BITS) if value >> 63 else value
    lengths = np.fromiter(map(len, tokens), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - words + 1].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], dtype="<u8")
    columns = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, i], minlength=256) @ BYTE_BITS for i in range(8)])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(`_id`, `_fp` long) for every row of `docs`."""
    return map_texts(id_and_text(docs, id_col, text_col), "_fp bigint", lambda texts: {"_fp": [simhash(t, words) for t in texts]})


class BkTree:
    """Children hang below a node keyed by their integer Hamming distance to it; values are not negative."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Adds a value not present yet and returns its index."""
        at, index = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        if index:
            while True:
                distance = (self.values[at] ^ value).bit_count()
                below = self.children[at].get(distance)
                if below is None:
                    self.children[at][distance] = index
                    break
                at = below
        return index

    def within(self, value: int, radius: int) -> list[int]:
        """Indices of all values at most `radius` bits away; only edges that can lead there are followed."""
        if not self.values:
            return []
        found, stack = [], [0]
        values, children = self.values, self.children
        while stack:
            at = stack.pop()
            distance = (values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            for edge, child in children[at].items():
                if -radius <= edge - distance <= radius:
                    stack.append(child)
        return found


class _Sets:
    """Union-find over small integers."""

    def __init__(self) -> None:
        self.up: list[int] = []

    def new(self) -> int:
        self.up.append(len(self.up))
        return len(self.up) - 1

    def join(self, a: int, b: int) -> bool:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        while up[b] != b:
            up[b] = up[up[b]]
            b = up[b]
        up[a] = b
        return a != b


def _links(radius: int):
    """Rows sorted by (_shard, _tree, _other, _query): trees first, then what is looked up in them.

    Gives a spanning set of links for each tree, never all pairs of a dense group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tree = sets = slots = known = None
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for shard, first, other, query, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (shard, first, other):
                    key, tree, sets, slots, known = (shard, first, other), BkTree(), _Sets(), [], []
                bits = fp & MASK  # distances are counted on numbers without a sign
                near = tree.within(bits, radius) if query or first == other else ()
                mine = None
                if near or not query:
                    mine = sets.new()
                for at in near:
                    if sets.join(mine, slots[at]):
                        a.append(fp)
                        b.append(known[at])
                if not query:
                    tree.add(bits)
                    known.append(fp)
                    slots.append(mine)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _shards(fp: Column, radius: int, agree: int) -> Column:
    """One long for each choice of `agree` blocks: its number, then the values of its blocks."""
    blocks = radius + agree
    bounds = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), agree)):
        key = F.lit(number).cast("long")
        for block in chosen:
            width = bounds[block + 1] - bounds[block]
            value = F.shiftrightunsigned(fp, bounds[block]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(value)
        keys.append(key)
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = 4, agree: int | None = None, tree_size: int = TREE_SIZE) -> DataFrame:
    """`distinct` (`_fp`, no repeats) -> links (a, b) that connect exactly what the radius connects.

    `agree` blocks must be equal within a shard; unless given, it follows the number of fingerprints so
    that a shard holds about `SHARD_MEAN` of them. Any value gives the same components.
    """
    if agree is None:
        n, agree = distinct.count(), 1
        while agree < 4 and n > SHARD_MEAN << (BITS * agree // (radius + agree)):
            agree += 1
    member = distinct.select("_fp", F.explode(_shards(F.col("_fp"), radius, agree)).alias("_shard"))
    sizes = member.groupBy("_shard").agg(F.count("*").alias("_n")).where(F.col("_n") > tree_size)
    parts = F.ceil(F.coalesce("_n", F.lit(1)) / tree_size).cast("int")
    spread = (
        member.join(sizes, "_shard", "left")
        .select("_shard", "_fp", parts.alias("_parts"), F.pmod(F.xxhash64("_fp"), parts).cast("int").alias("_part"))
        .select("_shard", "_fp", "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_with"))
        .select(
            "_shard", F.least("_part", "_with").alias("_tree"), F.greatest("_part", "_with").alias("_other"),
            (F.col("_with") < F.col("_part")).alias("_query"), "_fp",
        )
    )
    return (
        spread.repartition("_shard", "_tree", "_other")
        .sortWithinPartitions("_shard", "_tree", "_other", "_query", "_fp")
        .mapInArrow(_links(radius), "a bigint, b bigint")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, tree_size: int = TREE_SIZE
) -> DataFrame:
    """One row for each row of `docs`: (`_id`, `_fp` long, `_component`).

    Words are ASCII lower-cased and split at ASCII white space; shingles have `words` words, a shorter
    text is one shingle. Fingerprints within `radius` bits are linked; `_component` is the smallest id
    reachable over links. Texts without words, null or empty, have fingerprint zero and are linked like
    any other. Equal fingerprints are searched once, so copies make no pairs. Repeated rows are returned
    as often as they come. A null id never is the smallest; a component of null ids alone has a null
    `_component`. Other columns of `docs` are not looked at. An empty table gives no rows.
    """
    marked = checkpoint(fingerprints(docs, id_col, text_col, words))
    classes = checkpoint(marked.groupBy("_fp").agg(F.min("_id").alias("_rep")))
    roots = checkpoint(components(links(classes.select("_fp"), radius, tree_size=tree_size)))
    named = classes.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left")
    named = named.withColumn("_root", F.coalesce("component", "_fp")).select("_fp", "_rep", "_root")
    lowest = named.groupBy("_root").agg(F.min("_rep").alias("_component"))
    of_class = named.join(lowest, "_root").select("_fp", "_component")
    return marked.join(of_class, "_fp").select("_id", "_fp", "_component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component; rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, words, radius)
    drop = found.where("_id <> _component").select(F.col("_id").alias("_drop")).distinct()
    return docs.join(drop, docs[id_col] == drop["_drop"], "left_anti")
