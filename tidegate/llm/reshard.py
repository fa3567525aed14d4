"""Resharding as a minimum-cost flow: the fewest bytes change shards, then affected files are rewritten.

Rows of an old shard fall into blocks by a hash of their id. Blocks are the units of transfer; only their
sizes, a table bounded by old shards x blocks, reach the driver. There a minimum-cost flow from old shards
to the capacities of the new ones says how many bytes go where, and blocks are chosen to fill the flows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import checkpoint

BLOCKS = 256


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] with row sums `supply`, column sums at most `capacity`, at the least total cost.

    Successive shortest paths with potentials over the bipartite graph of shards; costs are not negative.
    A total capacity below the total supply raises an error.
    """
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities are too small")
    flow = [[0] * m for _ in range(n)]
    left, free, potential = list(supply), list(capacity), [0] * (n + m)
    while any(left):
        distance, back, done = [float("inf")] * (n + m), [-1] * (n + m), [False] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                distance[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, at = heapq.heappop(heap)
            if done[at]:
                continue
            done[at] = True
            if at < n:
                steps = [(n + j, cost[at][j]) for j in range(m)]
            else:
                steps = [(i, -cost[i][at - n]) for i in range(n) if flow[i][at - n]]
            for to, c in steps:
                new = d + c + potential[at] - potential[to]
                if new < distance[to]:
                    distance[to], back[to] = new, at
                    heapq.heappush(heap, (new, to))
        target = min((j for j in range(m) if free[j]), key=lambda j: distance[n + j] + potential[n + j])
        far = distance[n + target]
        potential = [p + min(d, far) for p, d in zip(potential, distance)]
        path, at = [], n + target
        while at != -1:
            path.append(at)
            at = back[at]
        path.reverse()
        amount = min(left[path[0]], free[target], *(flow[b][a - n] for a, b in zip(path, path[1:]) if a >= n))
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[path[0]] -= amount
        free[target] -= amount
    return flow


def assign_blocks(blocks: dict[tuple[int, int], int], flow: list[list[int]]) -> dict[tuple[int, int], int]:
    """(old shard, block) -> new shard: largest blocks first, each to where most of its flow is unfilled."""
    left = [list(row) for row in flow]
    to = {}
    for (old, block), size in sorted(blocks.items(), key=lambda x: (-x[1], x[0])):
        row = left[old]
        new = max(range(len(row)), key=lambda j: (row[j], old == j, -j))
        row[new] -= size
        to[old, block] = new
    return to


def placement(
    docs: DataFrame, old_shard: str, new_shards: int, id_col: str = "doc_id", text_col: str = "text",
    weights: list[int] | None = None, blocks: int = BLOCKS,
) -> DataFrame:
    """(`_id`, `size`, `text_crc32`, `old_shard`, `block`, `shard`, `slot`) for every row of `docs`.

    `old_shard` names the column of old shard numbers from 0 (null counts as 0). New capacities are equal,
    or in proportion to `weights`. `size` is the text's UTF-8 bytes plus 1, so null and empty texts have
    1; their crc is 0. Slots number the rows of a shard from 0 without gaps; ties and repeated rows get
    slots of their own in an arbitrary order. Null ids share a block. Other columns are not looked at. An
    empty table gives no rows.
    """
    data = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        docs[id_col].alias("_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.coalesce(docs[old_shard].cast("int"), F.lit(0)).alias("old_shard"),
        F.pmod(F.xxhash64(docs[id_col]), F.lit(blocks)).cast("int").alias("block"),
    )
    rows = checkpoint(rows)
    sizes = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    of_block = {(r["old_shard"], r["block"]): r["bytes"] for r in sizes}
    old_count = 1 + max((o for o, _ in of_block), default=0)
    supply = [sum(s for (o, _), s in of_block.items() if o == i) for i in range(old_count)]
    shares = weights or [1] * new_shards
    total, bounds = sum(supply), [sum(shares[:j]) for j in range(new_shards + 1)]
    capacity = [total * bounds[j + 1] // bounds[-1] - total * bounds[j] // bounds[-1] for j in range(new_shards)]
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(new_shards)] for i in range(old_count)])
    to = assign_blocks(of_block, flow)
    count = {(r["old_shard"], r["block"]): r["n"] for r in sizes}
    begin, table = [0] * new_shards, []
    for key in sorted(to):
        table.append((*key, to[key], begin[to[key]]))
        begin[to[key]] += count[key]
    where = docs.sparkSession.createDataFrame(table, "old_shard int, block int, shard int, _begin long")
    number = F.row_number().over(Window.partitionBy("old_shard", "block").orderBy("_id", "text_crc32"))
    placed = rows.withColumn("_number", number).join(F.broadcast(where), ["old_shard", "block"])
    return placed.select(
        "_id", "size", "text_crc32", "old_shard", "block", "shard", (F.col("_begin") + F.col("_number") - 1).alias("slot")
    )


def write_layout(docs: DataFrame, old_shard: str, path: str, id_col: str = "doc_id", blocks: int = BLOCKS) -> None:
    """Writes `docs` as folders `_shard=../_block=..`, the form that `rewrite` moves."""
    shard, block = F.coalesce(docs[old_shard].cast("int"), F.lit(0)), F.pmod(F.xxhash64(docs[id_col]), F.lit(blocks)).cast("int")
    docs.withColumns({"_shard": shard, "_block": block}).repartition("_shard", "_block").write.partitionBy("_shard", "_block").parquet(path)


def rewrite(spark, path: str, target: str, moves: DataFrame) -> None:
    """Rewrites only the blocks that change shards: those of `moves` (`old_shard`, `block`, `shard`).

    Reads the affected folders of the layout at `path` and writes their rows below `target` under the new
    shard. Blocks that stay are neither read nor written; a new shard is its folders in `target` and its
    unmoved ones in `path`.
    """
    moved = moves.where("old_shard <> shard").select(
        F.col("old_shard").alias("_shard"), F.col("block").alias("_block"), F.col("shard").alias("_to")
    ).distinct()
    rows = spark.read.parquet(path).join(F.broadcast(moved), ["_shard", "_block"])
    rows.withColumn("_shard", F.col("_to")).drop("_to").repartition("_shard", "_block").write.partitionBy("_shard", "_block").parquet(target)
