"""Scans along ordered keys of which one may hold any share of the rows.

Rows are range-partitioned by key and order, so a hot key lies in several parts and no part is larger than
the others. Windows run inside (key, part). What crosses a border is taken from one summary row for each
(key, part) of the keys that lie in more than one part. A part can go on with one key only from the part
before it, so there are at most two such rows a part, and broadcasting them is bounded by the number of parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.session import checkpoint

PART = "_part"


def in_parts(rows: DataFrame, key: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """`rows` with `_part`, the range of (key, order) they lie in; written once, since the borders are sampled."""
    count = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(rows.repartitionByRange(count, *key, *order).withColumn(PART, F.spark_partition_id()))


def summaries(parted: DataFrame, key: list[str], values: dict[str, Column]) -> DataFrame:
    """One row (key, `_part`, values) for each part of the keys that lie in several parts."""
    each = parted.groupBy(*key, PART).agg(*[value.alias(name) for name, value in values.items()])
    rows = F.collect_list(F.struct(PART, *values))
    return each.groupBy(*key).agg(rows.alias("_rows")).where(F.size("_rows") > 1).select(*key, F.inline("_rows"))


def with_carried(parted: DataFrame, carried: DataFrame, key: list[str]) -> DataFrame:
    """`parted` with the other columns of `carried` (key, `_part`, ...), null where nothing is carried."""
    names = [c for c in carried.columns if c not in (*key, PART)]
    small = carried.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate((*key, PART))], *names)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate((*key, PART))])
    return parted.join(F.broadcast(small), same, "left").drop(*[f"_of_{i}" for i in range(len(key) + 1)])


def running(rows: DataFrame, key: list[str], order: list[str], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """`rows` with, under each name of `sums`, the sum of that column over the earlier rows of the key."""
    parted = in_parts(rows.withColumns(sums), key, order, parts)
    inside = Window.partitionBy(*key, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = summaries(parted, key, {name: F.sum(name) for name in sums})
    carried = totals.select(*key, PART, *[F.sum(name).over(before).alias(f"_before_{name}") for name in sums])
    here = parted.withColumns({name: F.sum(name).over(inside) for name in sums})
    zero = F.lit(0).cast("long")
    added = {name: F.coalesce(name, zero) + F.coalesce(f"_before_{name}", zero) for name in sums}
    return with_carried(here, carried, key).withColumns(added).drop(PART, *[f"_before_{name}" for name in sums])


def beside(rows: DataFrame, key: list[str], order: list[str], what: str, parts: int | None = None) -> DataFrame:
    """`rows` with `previous` and `following`: the values of `what` in the rows before and after it in the key."""
    parted = in_parts(rows, key, order, parts)
    inside = Window.partitionBy(*key, PART).orderBy(*order)
    across = Window.partitionBy(*key).orderBy(PART)
    place = F.struct(*order)
    ends = summaries(parted, key, {"_first": F.min_by(what, place), "_last": F.max_by(what, place)})
    carried = ends.select(*key, PART, F.lag("_last").over(across).alias("_came"), F.lead("_first").over(across).alias("_comes"))
    here = parted.withColumns({"previous": F.lag(what).over(inside), "following": F.lead(what).over(inside)})
    return (
        with_carried(here, carried, key)
        .withColumns({"previous": F.coalesce("previous", "_came"), "following": F.coalesce("following", "_comes")})
        .drop(PART, "_came", "_comes")
    )


def latest(rows: DataFrame, key: list[str], order: list[str], what: str, name: str, parts: int | None = None) -> DataFrame:
    """`rows` with `name`: the value of `what` in the last row of the key, up to and with this one, that has one."""
    parted = in_parts(rows, key, order, parts)
    inside = Window.partitionBy(*key, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max_by(what, F.when(F.col(what).isNotNull(), F.struct(*order)))
    carried = summaries(parted, key, {"_seen": seen}).select(*key, PART, F.last("_seen", ignorenulls=True).over(before).alias("_came"))
    here = parted.withColumn(name, F.last(what, ignorenulls=True).over(inside))
    return with_carried(here, carried, key).withColumn(name, F.coalesce(name, "_came")).drop(PART, "_came")


def gathered(rows: DataFrame, key: list[str], order: list[str], what: str, name: str, parts: int | None = None) -> DataFrame:
    """`rows` with `name`: the list of `what` over the earlier rows of the key, in order; nulls are left out.

    The lists of a key are as long as the key, so all of them together grow with its square. Rows pass one by one:
    no task holds more than its part and one list. What came before a part is a row of its own in front of it.
    """
    parted = in_parts(rows, key, order, parts)
    kind = parted.schema[what].dataType.simpleString()
    inside = Window.partitionBy(*key, PART).orderBy("_here", *order)
    across = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    split = summaries(parted, key, {"_split": F.lit(True)})
    values = F.sort_array(F.collect_list(F.struct(*order, F.col(what).alias("_what"))))
    lists = with_carried(parted, split, key).where("_split").groupBy(*key, PART).agg(
        F.array_compact(F.transform(values, lambda v: v["_what"])).alias("_list")
    )
    came = lists.select(*key, PART, F.flatten(F.collect_list("_list").over(across)).alias("_came"), F.lit(0).alias("_here"))
    every = parted.withColumn("_here", F.lit(1)).unionByName(came, allowMissingColumns=True)
    before = F.coalesce(F.first("_came").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.array().cast(f"array<{kind}>"))
    here = F.collect_list(what).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return every.withColumn(name, F.concat(before, here)).where("_here = 1").select(*rows.columns, name)
