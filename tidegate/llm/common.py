"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.session import checkpoint_dir, scratch_path


def checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from the written rows.

    The folder is the one the cluster names in `spark.checkpoint.dir`; only a session without that
    setting gets a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(spark) or scratch_path(spark, "checkpoints"))
    return df.checkpoint(eager=True)


def drop_finished(spark: SparkSession) -> None:
    """Asks the driver to let go of plans that are done with: only then Spark deletes their shuffle files, of which
    an iteration leaves a few for each task, stage and round."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def short_batches(df: DataFrame) -> DataFrame:
    """`df`, in a session that hands texts to Python some megabytes at a time: the default of 10,000 rows lets a
    batch of long texts, and the buffers on both sides, grow to hundreds."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


_caches: list[Callable[[], None]] = []


def worker_cache(fn: Callable) -> Callable:
    """Keeps what `fn` makes in the Python worker until `release_caches` is called there."""
    kept = lru_cache(maxsize=1)(fn)
    _caches.append(kept.cache_clear)
    return kept


def release_caches() -> None:
    """Python workers live on from stage to stage: one that needs room drops what others have left."""
    for clear in _caches:
        clear()


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only `_id` and `_text`: other columns, whatever their names, cannot clash."""
    docs = short_batches(docs)
    return docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"), *more)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches cut into short ones, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_texts(
    df: DataFrame, schema: str, fn: Callable[[list[str | None]], dict[str, list]], carry: tuple[str, ...] = ("_id",)
) -> DataFrame:
    """Columns of `carry` unchanged beside the columns `fn` makes of the texts of a batch."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = df.sparkSession.createDataFrame([], schema).schema
    kept = ", ".join(f"`{c}` {types[c].simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in slices(batches):
            made = fn(batch.column(batch.schema.get_field_index("_text")).to_pylist())
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in carry]
            arrays += [pa.array(made[f.name], to_arrow_type(f.dataType)) for f in out.fields]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carry, *(f.name for f in out.fields)])

    return df.select(*carry, "_text").mapInArrow(run, f"{kept}, {schema}")


def sample_texts(df: DataFrame, group: str | None, buckets: int, chars: int) -> DataFrame:
    """A bounded sample: for each group and each of `buckets` hash classes of `_id` one text's start.

    The row of a class is the one with the smallest hash, so the choice depends on neither order nor
    partitions; map-side combine leaves one row for each class and task.
    """
    keys = [F.pmod(F.xxhash64("_id"), F.lit(buckets)).alias("_bucket")] + ([F.col(group).alias("_group")] if group else [])
    picked = F.min(F.struct(F.xxhash64("_id", F.lit(1)).alias("h"), F.substring("_text", 1, chars).alias("t")))
    return df.groupBy(*keys).agg(picked.alias("_p")).select(*(["_group"] if group else []), F.col("_p.h").alias("h"), F.col("_p.t").alias("t"))


#: Counters that travel in one row of `slot_rows`.
SLOT_BLOCK = 1 << 12
SLOT_SCHEMA = "block bigint, sums binary"


def slot_rows(total: np.ndarray) -> pa.RecordBatch:
    """A task's counters as rows of `SLOT_SCHEMA`; their number is a multiple of `SLOT_BLOCK`."""
    parts = total.reshape(-1, SLOT_BLOCK)
    chosen = np.flatnonzero(parts.any(axis=1))
    sums = [parts[i].astype("<i8").tobytes() for i in chosen.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(chosen, pa.int64()), pa.array(sums, pa.binary())], names=["block", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `SLOT_SCHEMA` sorted by block -> one row for each block; one block is held at a time."""

    def told(block: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "sums"])

    now, total = None, np.zeros(SLOT_BLOCK, np.int64)
    for batch in slices(batches, 50):
        for block, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
            if block != now:
                if now is not None:
                    yield told(now, total)
                now, total = block, np.zeros(SLOT_BLOCK, np.int64)
            total = total + np.frombuffer(sums.as_buffer(), "<i8")
    if now is not None:
        yield told(now, total)


def sum_slots(rows: DataFrame, slots: int) -> np.ndarray:
    """`slots` counters, each the sum over all tasks (2^31 - 1 at most); the rows of a block are added up in
    two steps, first by groups of tasks."""
    rows = rows.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(32)))
    for keys in (["block", "_group"], ["block"]):
        rows = rows.repartition(*keys).sortWithinPartitions(*keys).select("block", "sums").mapInArrow(_added, SLOT_SCHEMA)
    counts = np.zeros(slots, np.int32)
    for r in rows.collect():
        most = np.minimum(np.frombuffer(r["sums"], "<i8"), (1 << 31) - 1)
        counts[r["block"] * SLOT_BLOCK : (r["block"] + 1) * SLOT_BLOCK] = most
    return counts


def bitmap_of(slots: DataFrame, bits: int) -> np.ndarray:
    """A bit for each number from 0 that a column `slot` holds; `bits` / 8 bytes, however many rows there are."""
    # bucket b of the functions holds the numbers 32768 (b - 1) + 1 to 32768 b
    number = F.col("slot") + 1
    parts = slots.groupBy(F.bitmap_bucket_number(number).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    made = np.zeros(bits // 8, np.uint8)
    for r in parts.where("b is not null").collect():
        made[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return made


def in_bitmap(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    slots = slots.astype(np.int64)
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)
