"""Exact substring dedup of word windows, partitioned by super-k-mers.

A window is `k` consecutive words. Consecutive windows of a document that share a minimiser (the smallest
hash of `m` words in the window) travel as one packed string to the minimiser's bucket: equal windows
have equal minimisers, so they always meet. There windows are sorted, and every place but the first of
each is a repeat. A task sends a window once however often it sees it, which bounds what a hot passage
sends; a bucket is worked off piece by piece and holds only distinct windows. A minimiser with more than
`HEAVY` windows is split by the smallest hash of `MIDDLE` words, and where that has as many again, by the
hash of the whole window; both are the same in equal windows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import SLOT_SCHEMA, id_and_text, slices, slot_rows, sum_slots

K = 20
M = 3
#: Text bytes of a map-side batch, and new packed words (in characters) that a bucket takes before it sorts again.
BATCH_BYTES = 4_000_000
BUCKET_BYTES = 4_000_000
#: Windows are counted by minimiser in `SLOTS` counters; a counter with more than `HEAVY` windows is split.
MIDDLE = 10
SLOTS = 1 << 18
HEAVY = 500_000
#: Of zstandard.
LEVEL = 6
NO_ID = -(1 << 63)
SEED = 42


class Segments:
    """Pieces of documents in the order of (id, first word): arrays beside one flat list of words."""

    def __init__(self, ids, keys, starts, lengths, words: list[bytes]) -> None:
        order = np.lexsort((starts, keys, ids))
        self.ids, self.keys, self.starts, self.lengths = (np.asarray(x, np.int64)[order] for x in (ids, keys, starts, lengths))
        if len(order) and not np.array_equal(order, np.arange(len(order))):
            ends = np.cumsum(lengths)
            begins = ends - lengths
            words = [w for i in order.tolist() for w in words[begins[i] : ends[i]]]
        self.words = words

    def __len__(self) -> int:
        return len(self.ids)


def _combined(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each `width` consecutive values, by doubling; the array keeps its length, the tail is void."""
    with np.errstate(over="ignore"):
        base, total, done = np.uint64(0x9E3779B97F4A7C15), np.zeros_like(hashes), 0
        power, part, size = np.uint64(1), hashes, 1

        def shift(x: np.ndarray, by: int) -> np.ndarray:
            return np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])

        factor = base
        while True:
            if width & size:
                total = total + shift(part, done) * power
                power, done = power * factor, done + size
            if done == width:
                return total
            part = part + shift(part, size) * factor
            factor, size = factor * factor, size * 2


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` consecutive values."""
    low, size = values, 1
    while size < width:
        step = min(size, width - size)
        low = np.concatenate([np.minimum(low[:-step], low[step:]), low[-step:]]) if step < len(low) else low
        size += step
    return low


def _first_places(codes: np.ndarray, windows: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """For each window start in `at` (ascending) the first start with the same `k` codes."""
    _, index, inverse = np.unique(windows[at], return_index=True, return_inverse=True)
    first = at[index[inverse]]
    repeated = np.flatnonzero(first != at)
    same = np.ones(len(repeated), bool)
    for j in range(k):
        same &= codes[at[repeated] + j] == codes[first[repeated] + j]
    if not same.all():  # different windows with one hash: compare their words instead
        doubtful = np.flatnonzero(np.isin(first, first[repeated[~same]]))
        seen: dict[bytes, int] = {}
        for i in doubtful.tolist():
            first[i] = seen.setdefault(codes[at[i] : at[i] + k].tobytes(), int(at[i]))
    return first


def _minimisers(hashes: np.ndarray, k: int, m: int) -> np.ndarray:
    """Smallest hash of `m` words in each window of `k`."""
    grams = _combined(hashes, m)
    return _lowest(grams ^ (grams >> np.uint64(31)), k - m + 1)


def _routes(hashes: np.ndarray, windows: np.ndarray, at: np.ndarray, k: int, m: int, heavy) -> np.ndarray:
    """What decides the bucket of each window in `at`: its minimiser unless `heavy` says to split it."""
    route = _minimisers(hashes, k, m)[at]
    if heavy is not None:
        hot = np.flatnonzero(heavy[0][(route % np.uint64(SLOTS)).astype(np.int64)])
        if len(hot):
            middle = _minimisers(hashes, k, min(MIDDLE, k))[at[hot]]
            whole = windows[at[hot]]
            route[hot] = np.where(heavy[1][(middle % np.uint64(SLOTS)).astype(np.int64)], whole ^ (whole >> np.uint64(31)), middle)
    return route


def split_repeats(segments: Segments, k: int, m: int, heavy=None):
    """(repeats, pieces): runs of windows seen earlier, and runs of the rest that share a minimiser.

    `repeats` are rows (id, key, start, windows). `pieces` are (id, key, start, windows, minimiser, first,
    end) with the flat word positions. A place with the id and start of the first one is not earlier or
    later than it and stays.
    """
    n = len(segments.words)
    ends = np.cumsum(segments.lengths)
    owner = np.repeat(np.arange(len(segments), dtype=np.int32), segments.lengths)
    place = np.arange(n) - (ends - segments.lengths)[owner] + segments.starts[owner]
    code_of: dict[bytes, int] = defaultdict(count().__next__)
    codes = np.fromiter(map(code_of.__getitem__, segments.words), np.int32, n)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in code_of), np.uint64, len(code_of))[codes]
    at = np.flatnonzero(np.arange(n) + k <= ends[owner]).astype(np.int32)
    if not len(at):
        return np.zeros((0, 4), np.int64), []
    windows = _combined(hashes, k)
    first = _first_places(codes, windows, at, k)
    who = segments.ids[owner]
    repeat = (who[first] != who[at]) | (place[first] != place[at])
    minimiser = _routes(hashes, windows, at, k, m, heavy)

    def runs(chosen: np.ndarray, *differ: np.ndarray):
        """First and last position in `at` of each run of neighbours among `chosen`."""
        if not len(chosen):
            return chosen, chosen
        cut = (np.diff(at[chosen]) != 1) | (np.diff(owner[at[chosen]]) != 0)
        for values in differ:
            cut |= values[chosen][1:] != values[chosen][:-1]
        edges = np.flatnonzero(cut)
        return chosen[np.concatenate([[0], edges + 1])], chosen[np.concatenate([edges, [len(chosen) - 1]])]

    a, b = runs(np.flatnonzero(repeat))
    o = owner[at[a]]
    repeats = np.stack([segments.ids[o], segments.keys[o], place[at[a]], b - a + 1], axis=1)
    a, b = runs(np.flatnonzero(~repeat), minimiser)
    o = owner[at[a]]
    return repeats, (segments.ids[o], segments.keys[o], place[at[a]], b - a + 1, minimiser[a], at[a], at[b] + k)


#: How the columns id, key, start, windows are written.
FORMATS = ("<i8", "<u4", "<u4", "<u4")


def _pack(kind: int, numbers: np.ndarray, text: bytes) -> bytes:
    head = np.array([kind, len(numbers)], "<i8").tobytes()
    columns = b"".join(numbers[:, i].astype(f).tobytes() for i, f in enumerate(FORMATS))
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + columns + text)


def _unpack(blob: bytes) -> tuple[int, np.ndarray, bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    kind, n = np.frombuffer(data, "<i8", 2).tolist()
    at, columns = 16, []
    for f in FORMATS:
        columns.append(np.frombuffer(data, f, n, at).astype(np.int64))
        at += n * np.dtype(f).itemsize
    return kind, np.stack(columns, axis=1), data[at:]


def _window_counts(k: int, m: int, heavy: np.ndarray | None = None):
    """Texts -> rows of `SLOT_SCHEMA`: windows by the smallest hash of `m` words, a batch of texts at a time; or,
    of the windows that are `heavy` by it, by the smallest hash of `MIDDLE` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, digest = np.zeros(SLOTS, np.int64), xxhash.xxh64_intdigest

        def count_in(words: list[bytes], lengths: list[int]) -> None:
            code_of: dict[bytes, int] = defaultdict(count().__next__)
            codes = np.fromiter(map(code_of.__getitem__, words), np.int32, len(words))
            hashes = np.fromiter((digest(w, SEED) for w in code_of), np.uint64, len(code_of))[codes]
            ends = np.cumsum(lengths)
            valid = np.ones(len(words), bool)
            for j in range(1, k):
                valid[ends - j] = False
            found = (_minimisers(hashes, k, m) % np.uint64(SLOTS)).astype(np.int64)
            if heavy is not None:
                valid &= heavy[found]
                found = (_minimisers(hashes, k, min(MIDDLE, k)) % np.uint64(SLOTS)).astype(np.int64)
            total[:] += np.bincount(found[valid], minlength=SLOTS)

        words, lengths, size = [], [], 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                tokens = (text or "").encode("utf-8", "surrogatepass").split()
                if len(tokens) >= k:
                    words += tokens
                    lengths.append(len(tokens))
                    size += len(text)
                if size >= BATCH_BYTES:
                    count_in(words, lengths)
                    words, lengths, size = [], [], 0
        if words:
            count_in(words, lengths)
        yield slot_rows(total)

    return run


def _heavy(rows: DataFrame, k: int, m: int) -> np.ndarray | None:
    """Counters with more than `HEAVY` windows, for both levels; null if there are none at the first."""
    texts = rows.select("_text")
    first = sum_slots(texts.mapInArrow(_window_counts(k, m), SLOT_SCHEMA), SLOTS) > HEAVY
    if not first.any():
        return None
    return np.stack([first, sum_slots(texts.mapInArrow(_window_counts(k, m, first), SLOT_SCHEMA), SLOTS) > HEAVY])


def _to_buckets(k: int, m: int, buckets: int, heavy=None):
    """Documents -> rows (bucket, packed super-k-mers) and, in any bucket, packed repeats found already."""

    def flush(ids, keys, lengths, words):
        segments = Segments(ids, keys, np.zeros(len(ids), np.int64), np.array(lengths, np.int64), words)
        repeats, pieces = split_repeats(segments, k, m, heavy)
        out = []
        if len(repeats):
            out.append((int(abs(int(repeats[0].sum()))) % buckets, _pack(0, repeats, b"")))
        if len(pieces):
            who, key, start, windows, minimiser, first, end = pieces
            bucket = (minimiser % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            numbers = np.stack([who, key, start, windows], axis=1)[order]
            texts = [b" ".join(segments.words[a:b]) for a, b in zip(first[order].tolist(), end[order].tolist())]
            edges = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)]
            out += [(int(bucket[order[a]]), _pack(1, numbers[a:b], b"\n".join(texts[a:b]))) for a, b in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "packed"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, lengths, words, size = [], [], [], [], 0
        for batch in slices(batches):
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = (text or "").encode("utf-8", "surrogatepass").split()
                if len(tokens) < k:
                    continue
                ids.append(doc)
                keys.append(key)
                lengths.append(len(tokens))
                words += tokens
                size += len(text)
                if size >= BATCH_BYTES:
                    yield flush(ids, keys, lengths, words)
                    ids, keys, lengths, words, size = [], [], [], [], 0
        if ids:
            yield flush(ids, keys, lengths, words)

    return run


def _in_buckets(k: int, m: int):
    """Rows of (bucket, packed), sorted by bucket -> repeats (id, key, start, windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(values: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values[:, i], pa.int64()) for i in range(4)], names=["_id", "_key", "start", "n"])

        now, held, kept, fresh = None, [], 0, 0

        def settle(last: bool):
            nonlocal held, kept, fresh
            if not held:
                return None
            numbers = np.concatenate([x[0] for x in held])
            words = b" ".join(x[1] for x in held).split()
            segments = Segments(*numbers.T[:3], numbers[:, 3] + k - 1, words)
            repeats, pieces = split_repeats(segments, k, m)
            held, kept, fresh = [], 0, 0
            if not last and len(pieces):
                who, key, start, windows, _, first, end = pieces
                text = b"\n".join(b" ".join(segments.words[a:b]) for a, b in zip(first.tolist(), end.tolist()))
                held, kept = [(np.stack([who, key, start, windows], axis=1), text)], len(text)
            return repeats

        for batch in slices(batches, 50):
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now:
                    found = settle(True)
                    if found is not None and len(found):
                        yield rows(found)
                    now = bucket
                kind, numbers, text = _unpack(packed.as_buffer())
                if kind == 0:
                    yield rows(numbers)
                    continue
                held.append((numbers, text))
                fresh += len(text)
                if fresh >= max(BUCKET_BYTES, kept):
                    found = settle(False)
                    if len(found):
                        yield rows(found)
        found = settle(True)
        if found is not None and len(found):
            yield rows(found)

    return run


def _whole_id(row_id: Column, text: Column) -> Column:
    """Ids as whole numbers; null ids come first, each text with one of 2^62 numbers of its own."""
    return F.coalesce(row_id.cast("long"), F.lit(NO_ID) + F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)))


def _key(text: Column) -> Column:
    """Tells rows of one id with different texts apart: 32 bits of a hash."""
    return F.xxhash64(text).bitwiseAND(F.lit((1 << 32) - 1))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M) -> DataFrame:
    """(`_id`, `_key`, `start`, `n`): runs of `n` windows from word `start` that also start earlier.

    `_key` is a hash of the text. Ids are whole numbers; null ids come before all others, and among them a
    hash of the text decides.
    """
    rows = id_and_text(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = int(min(2**31 - 1, max(16, 3 * size // BUCKET_BYTES)))
    rows = rows.select(_whole_id(F.col("_id"), F.col("_text")).alias("_id"), _key(F.col("_text")).alias("_key"), "_text")
    packed = rows.mapInArrow(_to_buckets(k, m, buckets, _heavy(rows, k, m)), "bucket int, packed binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_in_buckets(k, m), "_id bigint, _key bigint, start bigint, n bigint")


def cut(text: str | None, starts: list[int] | None, counts: list[int] | None, k: int) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by a space)."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not starts:
        return len(words), 0, b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, np.array(starts), 1)
    np.add.at(change, np.minimum(np.array(starts) + np.array(counts) + k - 1, len(words)), -1)
    gone = np.cumsum(change[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M) -> DataFrame:
    """All columns of `docs` and two more: starts and numbers of the runs of repeated windows of each row, or
    null. They are called `_starts` and `_counts`, behind as many marks as tell them from columns of `docs`."""
    mark = "_"
    while {f"{mark}starts", f"{mark}counts"} & set(docs.columns):
        mark += "_"
    runs = repeats(docs, id_col, text_col, k, m).groupBy("_id", "_key").agg(F.collect_list(F.struct("start", "n")).alias("_runs"))
    runs = runs.select(F.col("_id").alias("_rid"), F.col("_key").alias("_rkey"), F.col("_runs.start").alias(f"{mark}starts"), F.col("_runs.n").alias(f"{mark}counts"))
    text = docs[text_col].cast("string")
    match = (_whole_id(docs[id_col], text) == runs["_rid"]) & (_key(text) == runs["_rkey"])
    return docs.join(runs, match, "left").select(*(docs[c] for c in docs.columns), runs[f"{mark}starts"], runs[f"{mark}counts"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M) -> DataFrame:
    """(`_id`, `n_words`, `n_removed`, `kept`) for every row of `docs`.

    Words are runs of anything but ASCII white space, unchanged. Each word is removed that is covered by a
    window of `k` words which also starts earlier: in a smaller id, or earlier in the same document. All
    windows are judged on the input. Null and empty texts, and texts of fewer than `k` words, lose nothing.
    Repeated rows of one id and text are neither earlier nor later than each other and get equal results;
    null ids come before all others, rows of one text as one document. Other columns are not looked at. An empty table gives no rows.
    """
    rows = with_repeats(id_and_text(docs, id_col, text_col), "_id", "_text", k, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, starts, counts = (batch.column(i).to_pylist() for i in (1, 2, 3))
            made = [cut(*x, k) for x in zip(texts, starts, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.int64()),
                 pa.array([x[2].decode("utf-8", "surrogatepass") for x in made], pa.string())],
                names=["_id", "n_words", "n_removed", "kept"],
            )

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M) -> DataFrame:
    """`docs` with repeats cut out of the texts they change; a row whose words all go is dropped.

    A text that loses nothing stays as it is, white space included; a changed text has its kept words
    joined by one space. The other columns keep their values.
    """
    rows = with_repeats(docs, id_col, text_col, k, m)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, starts, counts = (batch.column(i).to_pylist() for i in (at, len(names), len(names) + 1))
            made = [cut(t, s, c, k)[2].decode("utf-8", "surrogatepass") if s else t for t, s, c in zip(texts, starts, counts)]
            columns = [pa.array(made, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            keep = pa.array([not s or m != "" for s, m in zip(starts, made)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    return rows.mapInArrow(run, docs.schema)
