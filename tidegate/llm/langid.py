"""Language identification by cross-parsing against suffix automata of labelled text.

A text is cut greedily into the longest phrases that occur in a language's sample text; few phrases
mean a likely language. Phrases do not cross words, so the phrase counts of a word are found once and
kept in the worker. The cost of a text under a language is phrases x log2(sample length), the number of
bits that naming all phrases takes; divided by its characters, it is the cross-parsing entropy.
"""

from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import id_and_text, map_texts, release_caches, sample_texts, short_batches, slices

TEXTS_PER_LANGUAGE = 64
CHARS_PER_TEXT = 400
MAX_LANGUAGES = 512
#: Of all languages together; automata take about 400 bytes a character in a worker.
MAX_SAMPLE_CHARS = 800_000
CACHE_WORDS = 150_000
UNDETERMINED = "und"
#: A text is in no learned language where it needs more bits a character than this many times the median
#: of labelled texts (or their 95 % quantile, if higher), and `SLACK` phrases more, which short texts need.
LIMIT = 2.0
SLACK = 4
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of `text`; state 0 is the start."""
    nxt: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        at = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = at
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[at] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[at] = clone
        last = at
    return nxt


def phrases(nxt: list[dict[str, int]], text: str) -> int:
    """Longest-match phrases that spell `text`; a character the sample lacks is a phrase of its own."""
    count, state, start = 0, 0, nxt[0]
    for c in text:
        to = nxt[state].get(c) if state else None
        if to is None:
            count += 1
            to = start.get(c, 0)
        state = to
    return count


def _characters(words: list[str]) -> int:
    """Of all words, each with the spaces around it, as they are cut into phrases."""
    return sum(map(len, words)) + 2 * len(words)


class Model:
    """Sample text by language; automata are built once in each Python worker."""

    _built: dict[int, tuple[list, dict]] = {}

    def __init__(self, samples: dict[str, str]) -> None:
        self.languages = sorted(samples)
        self.texts = [samples[x] for x in self.languages]
        self.bits = [math.log2(max(2, len(t))) for t in self.texts]
        self.key = zlib.crc32(repr((self.languages, self.texts)).encode("utf-8", "surrogatepass"))

    def _parts(self):
        if self.key not in Model._built:
            Model._built.clear()
            Model._built[self.key] = ([automaton(t) for t in self.texts], {})
        return Model._built[self.key]

    def _costs(self, words: list[str]) -> list[float]:
        """Bits of all words under each language."""
        automata, cache = self._parts()
        if len(cache) > CACHE_WORDS:
            cache.clear()
        total = 0
        for w in words:
            packed = cache.get(w)
            if packed is None:
                packed = 0
                spaced = f" {w} "
                for nxt in automata:
                    packed = packed << 40 | phrases(nxt, spaced)
                cache[w] = packed
            total += packed
        costs = []
        for bits in reversed(self.bits):
            costs.append((total & 0xFFFFFFFFFF) * bits)
            total >>= 40
        costs.reverse()
        return costs

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is the share of the best language when each language weighs 2 to
        the power of minus its bits. No letters, no text or no languages: (`und`, 0). Ties go to the
        language that sorts first."""
        words = WORD.findall((text or "").lower())
        if not words or not self.languages:
            return UNDETERMINED, 0.0
        costs = self._costs(words)
        best = min(range(len(costs)), key=costs.__getitem__)
        return self.languages[best], 1 / sum(2.0 ** max(-1000.0, costs[best] - c) for c in costs)

    def rate(self, text: str | None) -> float | None:
        """Bits a character of the text under its best language; null without letters or languages."""
        words = WORD.findall((text or "").lower())
        return min(self._costs(words)) / _characters(words) if words and self.languages else None

    def identified(self, text: str | None, limits: dict[str, float]) -> bool:
        """Whether the text has letters and its best language needs no more bits than the limit of that
        language allows. Without a limit, or without languages, letters are enough."""
        words = WORD.findall((text or "").lower())
        if not words or not self.languages:
            return bool(words)
        costs = self._costs(words)
        best = min(range(len(costs)), key=costs.__getitem__)
        limit = limits.get(self.languages[best])
        return limit is None or costs[best] <= limit * _characters(words) + SLACK * self.bits[best]


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    texts_per_language: int = TEXTS_PER_LANGUAGE, chars_per_text: int = CHARS_PER_TEXT,
) -> Model:
    """Learns from a bounded sample: at most `texts_per_language` texts of a language, of each the first
    `chars_per_text` characters, chosen by a hash of the id among rows with text and language. At most
    `MAX_LANGUAGES` languages, so that the model has a bound; more raise an error. Many languages share
    `MAX_SAMPLE_CHARS` equally."""
    rows = id_and_text(docs, id_col, text_col, docs[lang_col].cast("string").alias("_lang")).where("_lang IS NOT NULL AND _text IS NOT NULL")
    found = rows.select("_lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if found > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    chars_per_text = min(chars_per_text, MAX_SAMPLE_CHARS // (max(1, found) * texts_per_language))
    samples: dict[str, list] = {}
    for r in sample_texts(rows, "_lang", texts_per_language, chars_per_text).collect():
        samples.setdefault(r["_group"], []).append((r["h"], r["t"]))
    joined = {lang: " ".join(" ".join(WORD.findall(t.lower())) for _, t in sorted(texts)) for lang, texts in samples.items()}
    return Model({lang: f" {t} " for lang, t in joined.items() if t.strip()})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`_id`, `lang_pred`, `score`) for every row, from the whole text and nothing else.

    Null texts and texts without letters: `und`, score 0. Repeated rows are predicted each. Other columns
    are not looked at. Empty tables give no rows.
    """

    def run(texts):
        made = [model.predict(t) for t in texts]
        return {"lang_pred": [m[0] for m in made], "score": [m[1] for m in made]}

    return map_texts(id_and_text(docs, id_col, text_col), "lang_pred string, score double", run)


def limits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    texts_per_language: int = TEXTS_PER_LANGUAGE, chars_per_text: int = CHARS_PER_TEXT,
) -> dict[str, float]:
    """For each language the most bits a character that a text in it may need.

    Learned on labelled rows that are not `held_out` and measured on a bounded sample of those that are.
    A language without such rows has no limit.
    """
    labelled = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"), docs[lang_col].cast("string").alias("_lang"))
    labelled = labelled.where("_lang IS NOT NULL AND _text IS NOT NULL")
    model = fit(labelled.where(~held_out(F.col("_id"))), "_id", "_text", "_lang", texts_per_language, chars_per_text)
    picked = sample_texts(labelled.where(held_out(F.col("_id"))), "_lang", texts_per_language, chars_per_text)
    rated = map_texts(picked.select("_group", F.col("t").alias("_text")), "rate double", lambda texts: {"rate": [model.rate(t) for t in texts]}, ("_group",))
    found = rated.where("rate IS NOT NULL").groupBy("_group").agg(F.percentile("rate", F.lit(0.5)).alias("mid"), F.percentile("rate", F.lit(0.95)).alias("high"))
    return {r["_group"]: max(LIMIT * r["mid"], r["high"]) for r in found.collect()}


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` in which a learned language is found.

    Texts that are null or have no letters go, and texts whose best language needs more bits a character
    than `limits` allows. The model is fitted on all labelled rows of `docs` itself (the bounded sample of
    `fit`); where no language can be learned, all texts with letters stay. The decision is made inside
    the row, so repeated rows, null ids and clashing names do not matter.
    """
    import pyarrow as pa

    model, allowed = fit(docs, id_col, text_col, lang_col), limits(docs, id_col, text_col, lang_col)
    at = docs.columns.index(text_col)

    def run(batches):
        release_caches()
        for batch in slices(batches):
            keep = [model.identified(t, allowed) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
        Model._built.clear()  # workers go on to other stages

    return short_batches(docs).mapInArrow(run, docs.schema)
