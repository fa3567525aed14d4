"""Phrase collocations by stripes: each prefix keys an associative counter of the words that follow it.

A task counts stripes over a batch of texts and sends them packed, all of a bucket of prefixes in one row;
the stripes of a prefix are merged elementwise. The stripe of the empty prefix counts the words, its total is the number of
all words; a merged stripe holds the extensions of its prefix with their counts. Three readings of the
texts suffice: words, then pairs of frequent words, then all longer phrases whose pairs are frequent. What is
frequent reaches the tasks as a bitmap of fixed size, which may let too much through but never too little;
counts are exact, since every stripe keeps the words themselves. The stripes of a hot prefix are cut by the
next word.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import bitmap_of, checkpoint, id_and_text, in_bitmap, slices

#: Text bytes of a map-side batch and of a bucket of stripes, bits of the bitmap, parts of a hot stripe; a prefix is
#: hot with 1 / HOT of all words.
BATCH_BYTES = 12_000_000
BUCKET_BYTES = 8_000_000
BITS = 1 << 25
PARTS = 64
HOT = 1000
SEED = 42
#: Of zstandard.
LEVEL = 3
MULTIPLIER = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Everything that ends a piece becomes a line break, a tab a space.
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
#: Stands between pieces; no UTF-8 text holds this byte.
BORDER = b"\xff"

PACKED = "bucket int, packed binary"
MERGED = "lang string, prefix string, total bigint, extensions array<struct<word:string,n:bigint,slot:bigint>>"


def _slot(folded):
    """The bit of a folded hash (numpy or whole numbers)."""
    return (folded ^ (folded >> (np.uint64(33) if isinstance(folded, np.ndarray) else 33))) % (np.uint64(BITS) if isinstance(folded, np.ndarray) else BITS)


def _phrase_slot(lang: str, words: list[bytes]) -> int:
    folded = xxhash.xxh64_intdigest(lang.encode(), SEED)
    for w in words:
        folded = (folded * MULTIPLIER + xxhash.xxh64_intdigest(w, SEED)) & MASK
    return _slot(folded)


class Batch:
    """Words of many pieces of one language as codes; `borders` are no words."""

    def __init__(self, lang: str, texts: list[bytes]) -> None:
        code_of: dict[bytes, int] = defaultdict(count().__next__)
        code_of[BORDER]
        flat = b"\n".join(texts).lower().translate(ENDS).replace(b"\n", b" \xff ").split()
        self.lang = lang
        self.codes = np.fromiter(map(code_of.__getitem__, flat), np.int64, len(flat))
        self.words = list(code_of)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in self.words), np.uint64, len(self.words))
        self.real = self.codes != 0

    def frequent(self, bitmap: np.ndarray, words: int) -> np.ndarray:
        """For each place whether the `words` words from there on may be frequent."""
        n = len(self.codes)
        size = max(0, n - words + 1)
        folded = np.full(size, xxhash.xxh64_intdigest(self.lang.encode(), SEED), np.uint64)
        good = np.ones(size, bool)
        with np.errstate(over="ignore"):
            for j in range(words):
                folded = folded * np.uint64(MULTIPLIER) + self.hashes[self.codes[j : j + size]]
                good &= self.real[j : j + size]
        good &= in_bitmap(bitmap, _slot(folded))
        return np.concatenate([good, np.zeros(n - size, bool)])

    def among(self, slots: list[int]) -> np.ndarray:
        """For each word whether it has one of the `slots` as a phrase of one word."""
        with np.errstate(over="ignore"):
            folded = np.uint64(xxhash.xxh64_intdigest(self.lang.encode(), SEED)) * np.uint64(MULTIPLIER) + self.hashes
        return np.isin(_slot(folded), np.array(slots, np.uint64))

    def stripes(self, prefix: np.ndarray, at: np.ndarray, words: int, cut, buckets: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
        """(bucket, prefix and its next words, their counts) for phrases of `words` words at the places `at`
        (ascending), whose words but the last have the numbers `prefix`; `cut` tells places of hot prefixes."""
        if not len(at):
            return
        after = self.codes[at + words - 1]
        part = np.where(cut, (self.hashes[after] % np.uint64(PARTS)).astype(np.int64), 0)
        width = len(self.words)
        keys, first, n = np.unique((prefix * PARTS + part) * width + after, return_index=True, return_counts=True)
        group = keys // width
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(keys)]
        following, n = (keys % width).tolist(), n.astype("<i4")
        places = at[first[edges[:-1]]]
        folded = (group[edges[:-1]] % PARTS).astype(np.uint64)
        with np.errstate(over="ignore"):
            for j in range(words - 1):
                folded = folded * np.uint64(MULTIPLIER) + self.hashes[self.codes[places + j]]
            bucket = (((folded ^ (folded >> np.uint64(33))) * np.uint64(MULTIPLIER)) >> np.uint64(20)) % np.uint64(buckets)
        name = self.words.__getitem__
        for where, place, a, b in zip(bucket.tolist(), places.tolist(), edges, edges[1:]):
            head = b" ".join(map(name, self.codes[place : place + words - 1].tolist()))
            yield where, head + b"\t" + b" ".join(map(name, following[a:b])), n[a:b]


def _numbered(above: np.ndarray, codes: np.ndarray, width: int) -> np.ndarray:
    """New numbers for the pairs (number of the phrase so far, next word)."""
    return np.unique(above * width + codes, return_inverse=True)[1]


def _level_rows(batch: Batch, level: int, longest: int, bitmap: np.ndarray | None, hot: list[int], buckets: int) -> Iterator[tuple]:
    """Stripes of one reading: 1 words, 2 pairs, 3 phrases of 3 to `longest` words."""
    if level == 1:
        at = np.flatnonzero(batch.real)
        yield from batch.stripes(np.zeros(len(at), np.int64), at, 1, np.ones(len(at), bool), buckets)
        return
    known = batch.frequent(bitmap, level - 1)
    hot_head = batch.among(hot)
    good = known.copy()
    number, width = batch.codes, len(batch.words)
    for words in range(2, longest + 1):
        shift = words - level + 1  # the last part of the phrase that has to be frequent starts here
        if level == 3 and words == 2:
            at = np.flatnonzero(good)
            fresh = np.full(len(number), -1, np.int64)
            fresh[at] = _numbered(number[at], batch.codes[at + 1], width)
            number = fresh
            continue
        good[: len(good) - shift] &= known[shift:]
        good[len(good) - shift :] = False
        at = np.flatnonzero(good)
        yield from batch.stripes(number[at], at, words, hot_head[batch.codes[at]], buckets)
        if level == 2:
            return
        fresh = np.full(len(number), -1, np.int64)
        fresh[at] = _numbered(number[at], batch.codes[at + words - 1], width)
        number = fresh


def _pack(held: dict[str, tuple[list[bytes], list[np.ndarray]]]) -> bytes:
    """Stripes of a bucket by language: counts, then a line for each stripe."""
    sizes = [(lang, len(lines), sum(map(len, counts))) for lang, (lines, counts) in held.items()]
    head = json.dumps(sizes).encode()
    numbers = np.concatenate([c for _, counts in held.values() for c in counts]).tobytes()
    text = b"\n".join(line for lines, _ in held.values() for line in lines)
    return zstandard.ZstdCompressor(level=LEVEL).compress(len(head).to_bytes(8, "little") + head + numbers + text)


def _unpack(blob) -> Iterator[tuple[str, list[bytes], list[int]]]:
    """(language, lines, counts) of each language of a packed bucket."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    at = 8 + int.from_bytes(data[:8], "little")
    sizes = json.loads(data[8:at])
    numbers = np.frombuffer(data, "<i4", sum(n for *_, n in sizes), at).tolist()
    lines, a, b = data[at + 4 * len(numbers) :].split(b"\n"), 0, 0
    for lang, n_lines, n_counts in sizes:
        yield lang, lines[a : a + n_lines], numbers[b : b + n_counts]
        a, b = a + n_lines, b + n_counts


def _stripes(level: int, longest: int, bitmap, hot: list[int], buckets: int, batch_bytes: int):
    """Rows (lang, text) -> rows of PACKED; a batch of texts is counted before anything is sent."""

    def flush(texts_of: dict[str, list[bytes]]) -> pa.RecordBatch:
        held: dict[int, dict[str, tuple[list, list]]] = {}
        for lang, texts in texts_of.items():
            for bucket, line, counts in _level_rows(Batch(lang, texts), level, longest, bitmap.value if bitmap else None, hot, buckets):
                lines, numbers = held.setdefault(bucket, {}).setdefault(lang, ([], []))
                lines.append(line)
                numbers.append(counts)
        order = sorted(held)
        return pa.RecordBatch.from_arrays(
            [pa.array(order, pa.int32()), pa.array([_pack(held.pop(b)) for b in order], pa.binary())], names=["bucket", "packed"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in slices(batches, 200):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    data = text.encode("utf-8", "surrogatepass")
                    held.setdefault(lang, []).append(data)
                    size += len(data)
                    if size >= batch_bytes:
                        yield flush(held)
                        held, size = {}, 0
        yield flush(held)

    return run


def _merge(least: int):
    """Rows of PACKED sorted by bucket -> rows of MERGED: the stripes of a prefix added up word by word.

    Memory is bounded by the different phrases of one bucket; buckets grow in number, not in size.
    """
    shape = pa.schema([
        ("lang", pa.string()), ("prefix", pa.string()), ("total", pa.int64()),
        ("extensions", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64()), ("slot", pa.int64())]))),
    ])

    def rows(counters: dict[tuple[str, bytes], dict[bytes, int]]) -> list[dict]:
        out = []
        for (lang, prefix), counter in counters.items():
            if prefix and max(counter.values()) < least:
                continue
            before = prefix.split(b" ") if prefix else []
            kept = [{"word": w.decode("utf-8", "surrogatepass"), "n": n, "slot": _phrase_slot(lang, [*before, w])} for w, n in counter.items() if n >= least]
            out.append({"lang": lang, "prefix": prefix.decode("utf-8", "surrogatepass"), "total": sum(counter.values()), "extensions": kept})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        counters: dict[tuple[str, bytes], dict[bytes, int]] = {}
        for batch in slices(batches, 50):
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now:
                    if made := rows(counters):
                        yield pa.RecordBatch.from_pylist(made, shape)
                    now, counters = bucket, {}
                for lang, lines, counts in _unpack(packed.as_buffer()):
                    at = 0
                    for line in lines:
                        prefix, _, following = line.partition(b"\t")
                        words = following.split(b" ")
                        numbers = counts[at : at + len(words)]
                        at += len(words)
                        counter = counters.get((lang, prefix))
                        if counter is None:
                            counters[lang, prefix] = dict(zip(words, numbers))
                        else:
                            for w, n in zip(words, numbers):
                                counter[w] = counter.get(w, 0) + n
        if made := rows(counters):
            yield pa.RecordBatch.from_pylist(made, shape)

    return run


def _grams(stripes: DataFrame) -> DataFrame:
    """(lang, prefix, word, n, slot): the frequent extensions of each prefix, as rows."""
    return stripes.select("lang", "prefix", F.explode("extensions").alias("e")).select("lang", "prefix", "e.word", "e.n", "e.slot")


def stripes(
    docs: DataFrame, least: int, longest: int, lang_col: str = "lang", text_col: str = "text", batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """Merged stripes of all prefixes of 0 to `longest` - 1 words: rows of MERGED.

    `extensions` are the words that follow a prefix, inside a piece, at least `least` times; `total` is,
    for the empty prefix, the number of all words (a sum over its rows).
    """
    rows = id_and_text(docs, text_col, text_col, F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("_lang")).select("_lang", "_text")
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = int(min(2**31 - 1, max(16, size // BUCKET_BYTES)))
    context, done, bitmap, hot = docs.sparkSession.sparkContext, None, None, set()
    for level in range(1, min(longest, 3) + 1):
        sent = rows.mapInArrow(_stripes(level, longest, bitmap, hot, buckets, batch_bytes), PACKED)
        dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
        made = checkpoint(dealt.mapInArrow(_merge(least), MERGED))
        done = made if done is None else done.union(made)
        if level < min(longest, 3):
            found = _grams(made)
            bitmap = context.broadcast(bitmap_of(found.select("slot"), BITS))
        if level == 1:
            words = made.agg(F.sum("total")).first()[0] or 0
            hot = [r["slot"] for r in found.where(F.col("n") * HOT > words).select("slot").collect()]
    return done


def _part(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(
    docs: DataFrame, least: int = 100, top: int = 2000, longest: int = 5, share: int = 100, lang_col: str = "lang", text_col: str = "text",
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """The best `top` phrases of each language: (`lang`, `rank` from 1, `phrase`, `a`, `l`, `r`, `n`, `score`).

    Texts are lower-cased in A-Z and split at `.,;:!?` and line breaks into pieces, those at spaces and tabs
    into words. Candidates are phrases of 2 to `longest` words that occur `a` >= `least` times inside
    pieces. Cut after the first words, with `l` and `r` occurrences of the parts and `n` words in all, a cut
    scores floor(1000 a n / (l r)); the lowest score counts, on ties the earliest cut. A candidate inside a
    longer one that occurs at least `share` % as often is dropped. Order: score, a descending, phrase.

    A null language is `und`; null and empty texts have no words; repeated rows count each; columns
    other than the two named are not looked at; an empty table gives no rows.
    """
    found = stripes(docs, least, longest, lang_col, text_col, batch_bytes)
    total = found.where("prefix = ''").groupBy("lang").agg(F.sum("total").alias("n"))
    phrase = F.when(F.col("prefix") == "", F.col("word")).otherwise(F.concat_ws(" ", "prefix", "word"))
    grams = checkpoint(_grams(found).select("lang", phrase.alias("phrase"), F.col("n").alias("a")))
    split = grams.withColumn("w", F.split("phrase", " ")).withColumn("size", F.size("w"))
    split = split.where("size > 1")

    # what a longer phrase says about each phrase inside it
    size = F.explode(F.when(F.col("size") > 2, F.sequence(F.lit(2), F.col("size") - 1)).otherwise(F.array().cast("array<int>")))
    inside = split.select("lang", "a", "w", "size", size.alias("k"))
    inside = inside.select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("at"))
    most = inside.groupBy("lang", _part(F.col("w"), F.col("at"), F.col("k")).alias("phrase")).agg(F.max("a").alias("most"))

    kept = split.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * share))
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("left"),
        _part(F.col("w"), F.col("k") + 1, F.size("w")).alias("right"),
    )
    of = grams.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    cuts = cuts.join(of, ["lang", "left"]).join(of.select("lang", F.col("left").alias("right"), F.col("l").alias("r")), ["lang", "right"])
    cuts = cuts.join(total, "lang")
    wide = "decimal(38,0)"
    above = F.lit(1000).cast(wide) * F.col("a").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    below = F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", "n", above.cast(wide).alias("above"), below.cast(wide).alias("below"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = best.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = parts.withColumn("_row", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_row") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
