"""Benchmark decontamination: test items found inside documents by containment of word shingles.

An item is contained in a document if at least `threshold` of its distinct shingles occur there. Items
are partitioned by their number of shingles q. In each partition the MinHash signature is the
q - ceil(threshold q) + 1 smallest shingle hashes: a document that lacks all of these lacks too many
shingles, so looking for any of them loses no pair, however long the document is. Candidates are then
verified by exact shingle containment. All steps are DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import checkpoint, id_and_text

WORDS = 5
THRESHOLD = 0.8
#: Rows of the item tables up to which they are broadcast (about 100 bytes each); beyond, they are joined by key.
BROADCAST_ROWS = 200_000


def _words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased. Give it a column of its own before it goes into a lambda."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def _shingles(words: Column, k: int) -> Column:
    """The texts of all shingles; none where there are fewer than `k` words."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1))),
        lambda i: F.when(F.size(words) >= k, F.array_join(F.slice(words, i, k), " ")),
    )


def _hashes(words: Column, k: int) -> Column:
    """Hashes of all shingles from the hashes of their words; none where there are fewer than `k` words."""
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *(F.get(words, i + j) for j in range(1, k))),
    )


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", k: int = WORDS, threshold: float = THRESHOLD,
) -> DataFrame:
    """(`_id`, `_item`, `n_item`, `n_shared`, `containment`): one row for each contained item of a document.

    `n_item` counts the distinct shingles of the item, `n_shared` those that the document has too. Items
    of fewer than `k` words, null and empty ones have no shingles and are never reported; nor are such
    documents. Rows that repeat an id count as one document (item) with the shingles of all its rows; null
    ids are one such id. Other columns are not looked at. An empty table on either side gives no rows.
    """
    wanted = id_and_text(items, item_col, item_text_col).select(F.col("_id").alias("_item"), _words(F.col("_text")).alias("_w"))
    wanted = wanted.select("_item", F.explode_outer(_shingles(F.col("_w"), k)).alias("_shingle")).where("_shingle IS NOT NULL").distinct()
    wanted = checkpoint(wanted.withColumn("_h", F.xxhash64(F.transform(F.split("_shingle", " "), lambda w: F.xxhash64(w)))))
    sizes = wanted.groupBy("_item").agg(F.count("*").alias("n_item"), F.sort_array(F.collect_list("_h")).alias("_all"))
    need = F.ceil(F.col("n_item") * threshold - 1e-9).cast("int")
    signature = sizes.select(
        "_item", F.explode(F.slice("_all", 1, F.col("n_item").cast("int") - need + 1)).alias("_h")
    )
    rows = wanted.count()

    # explode_outer: a plain explode would add a filter on the array's size, and with it the work twice
    texts = id_and_text(docs, id_col, text_col)
    hashed = texts.select("_id", F.transform(_words(F.col("_text")), lambda w: F.xxhash64(w)).alias("_w"))
    hashed = hashed.select("_id", F.explode_outer(_hashes(F.col("_w"), k)).alias("_h")).where("_h IS NOT NULL")
    pairs = hashed.join(_sized(signature.select("_h").distinct(), rows), "_h", "left_semi").distinct()
    pairs = checkpoint(pairs.join(_sized(signature, rows), "_h").select("_id", "_item").distinct())

    ids = pairs.select(F.col("_id").alias("_c")).distinct()
    found = texts.join(ids, F.col("_id").eqNullSafe(F.col("_c")), "left_semi")
    found = found.select("_id", _words(F.col("_text")).alias("_w"))
    found = found.select("_id", F.explode_outer(_shingles(F.col("_w"), k)).alias("_shingle")).where("_shingle IS NOT NULL")
    found = found.join(_sized(wanted, rows), "_shingle").select("_id", "_item", "_shingle").distinct()
    shared = found.groupBy("_id", "_item").agg(F.count("*").alias("n_shared"))
    return (
        shared.join(_sized(sizes.select("_item", "n_item", need.alias("_need")), rows), "_item")
        .where("n_shared >= _need")
        .select("_id", "_item", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id contains no item."""
    hits = contaminated(docs, items, id_col, text_col, item_text_col=item_text_col).select(F.col("_id").alias("_drop")).distinct()
    return docs.join(hits, docs[id_col].eqNullSafe(hits["_drop"]), "left_anti")
