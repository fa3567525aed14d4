"""Quality by ordinal regression: graded ratings under a cumulative-link model with shared text weights.

A text has one score, the sum of the weights of its distinct features, hashed into a fixed table. Ordered
thresholds cut the score into grades: P(grade <= j) = logistic(threshold j - score). The weights are fitted
on a bounded sample of rated texts; every text is then graded where it is read.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import id_and_text, map_texts

#: Ratings used for fitting at most, and size of the weight table.
MAX_RATED = 8_000
BUCKETS = 1 << 18
MIN_TEXTS = 20
EPOCHS = 150
RATE = 0.3
RIDGE = 1e-3
PREFIX = 5
CACHE = 200_000
WORD = re.compile(r"[^\W\d_]+")
MARKS = re.compile(r"[^\w\s]{2,}")


def features(text: str) -> set[str]:
    """Distinct lower-case words and starts of longer ones, runs of marks, and steps of the shares of
    capitals and repeats and of the length."""
    words = WORD.findall(text)
    if not words:
        return {"#none"}
    seen = set(map(str.lower, words))
    capitals = sum(map(str.isupper, words)) / len(words)
    found = seen | {"^" + w[:PREFIX] for w in seen if len(w) > PREFIX} | {f"#marks {m[:3]}" for m in set(MARKS.findall(text))}
    found.add(f"#capitals {int(capitals * 10)}")
    found.add(f"#repeats {int(math.log2(len(words) / len(seen)))}")
    found.add(f"#words {len(words).bit_length()}")
    return found


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Model:
    """Weights by bucket and ordered thresholds between the grades 0 .. len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    @cached_property
    def _cache(self) -> dict[str, float]:
        return {}

    def score(self, text: str) -> float:
        cache, total = self._cache, 0.0
        if len(cache) > CACHE:
            cache.clear()
        for f in features(text):
            w = cache.get(f)
            if w is None:
                w = cache[f] = float(self.weights[bucket(f)])
            total += w
        return total

    def tails(self, text: str | None) -> list[float]:
        """P(grade >= 1), P(grade >= 2), .. of a text; null counts as empty."""
        return (1 - _logistic(self.thresholds - self.score(text or ""))).tolist()


def train(grades: np.ndarray, starts: np.ndarray, buckets: np.ndarray, n_grades: int, epochs: int = EPOCHS) -> Model:
    """Maximum likelihood with a ridge, by full-batch adaptive gradient steps.

    `starts` has each text's first place in `buckets`. Buckets of fewer than `MIN_TEXTS` texts get no weight.
    """
    often = np.bincount(buckets, minlength=BUCKETS) >= MIN_TEXTS
    owner = np.repeat(np.arange(len(grades), dtype=np.int32), np.diff(np.append(starts, len(buckets))))
    used, columns = often[buckets], np.flatnonzero(often)
    index = np.zeros(BUCKETS, np.int32)
    index[columns] = np.arange(len(columns))
    place = index[buckets[used]]
    owner, n, m = owner[used], max(1, len(grades)), n_grades - 1
    grades = grades if len(grades) else np.zeros(1, np.int64)
    shares = np.cumsum(np.bincount(grades, minlength=n_grades) + 1.0)
    shares = np.log(shares[:-1] / (shares[-1] - shares[:-1]))
    w, first, gaps = np.zeros(len(columns)), shares[0], np.log(np.maximum(np.diff(shares), 1e-3))
    g_w, g_t = np.full(len(columns), 1e-8), np.full(m, 1e-8)
    for _ in range(epochs):
        theta = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        s = np.bincount(owner, w[place], n)
        high, low = _logistic(edge[grades + 1] - s), _logistic(edge[grades] - s)
        p = np.maximum(high - low, 1e-12)
        slope_w = np.bincount(place, ((1 - high - low))[owner], len(columns)) / n + RIDGE * w
        per_edge = np.bincount(grades + 1, high * (1 - high) / p, n_grades + 1) - np.bincount(grades, low * (1 - low) / p, n_grades + 1)
        slope_theta = -per_edge[1:-1] / n
        slope_t = np.concatenate([[slope_theta.sum()], [slope_theta[j + 1 :].sum() * math.exp(gaps[j]) for j in range(m - 1)]])
        g_w += slope_w**2
        g_t += slope_t**2
        w -= RATE * slope_w / np.sqrt(g_w)
        step = RATE * slope_t / np.sqrt(g_t)
        first -= step[0]
        gaps = gaps - step[1:]
    weights = np.zeros(BUCKETS, np.float32)
    weights[columns] = w
    return Model(weights, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def fit(
    docs: DataFrame, ratings: DataFrame, grade_col: str, n_grades: int, id_col: str = "doc_id", text_col: str = "text",
    max_rated: int = MAX_RATED,
) -> Model:
    """Fits on at most `max_rated` ratings, those whose hashed ids are smallest, with one text each.

    `ratings` has `id_col` and `grade_col` (0 .. n_grades - 1; nulls are left out). Ratings without a
    document and null texts add nothing; without any rated text all weights are zero.
    """
    rated = ratings.select(F.col(id_col).alias("_rid"), F.col(grade_col).cast("int").alias("_grade"))
    rated = rated.where(f"_rid IS NOT NULL AND _grade BETWEEN 0 AND {n_grades - 1}")
    rated = F.broadcast(rated.orderBy(F.xxhash64("_rid"), "_rid", "_grade").limit(max_rated))
    texts = id_and_text(docs, id_col, text_col).where("_text IS NOT NULL")
    # an id may repeat very often among the documents: the smallest text counts, so at most `max_rated` rows are collected
    texts = texts.join(rated, texts["_id"] == rated["_rid"]).groupBy("_rid", "_grade").agg(F.min("_text").alias("_text"))
    texts = texts.orderBy("_rid", "_grade").select("_grade", "_text")
    packed = lambda t: np.fromiter(map(bucket, features(t)), "<i4").tobytes()
    rows = map_texts(texts, "_f binary", lambda batch: {"_f": [packed(t) for t in batch]}, ("_grade",)).toPandas()
    grades = rows["_grade"].to_numpy(np.int64)
    lengths = rows["_f"].map(len).to_numpy(np.int64) // 4
    buckets = np.frombuffer(b"".join(rows["_f"]), "<i4")
    return train(grades, np.cumsum(lengths) - lengths, buckets, n_grades)


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`_id`, `expected_grade`, `tails`) for every row, from the whole text.

    `tails[j]` is P(grade > j); the expected grade is their sum. Null texts are graded as empty ones.
    Repeated rows are graded each; other columns are not looked at; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        made = [shared.value.tails(t) for t in texts]
        return {"expected_grade": [sum(m) for m in made], "tails": made}

    return map_texts(id_and_text(docs, id_col, text_col), "expected_grade double, tails array<double>", run)
