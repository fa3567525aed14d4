"""Token counts by a two-tier lookup of pre-token lengths on the map side.

No piece of the vocabulary has a space mark behind another character, joins letters with other
characters, or holds a line break; so the merges inside each pre-token (spaces, then letters only or other
characters only) do not depend on its neighbours, and a text's count is the sum over its pre-tokens. A small
broadcast table holds the lengths of frequent pre-tokens; misses are encoded by the tokenizer library and
kept in the worker. No pre-token is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import id_and_text, map_texts, sample_texts

SPACE = "▁"
#: Raised digits are word characters, but go with the digits here.
LETTERS = re.compile(r"[^\W\d_¹²³]+|[\W\d_¹²³]+")
PRE_TOKEN = re.compile(r"\n| *[^\W\d_¹²³]+| *(?:[^\w \n]|[\d_¹²³])+| +")
#: The hot table: at most HOT pre-tokens, counted on at most SAMPLE text starts of SAMPLE_CHARS characters.
HOT = 50_000
SAMPLE = 4096
SAMPLE_CHARS = 2000
CACHE = 200_000


@lru_cache(maxsize=4)
def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def splittable(path: str) -> bool:
    """Whether counts add up over pre-tokens for this model: no normalising, no piece across a border."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    normal = [p.piece for p in model.pieces if p.type in (1, 4)]
    spec = model.normalizer_spec
    return (
        model.trainer_spec.model_type == 2 and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        and spec.add_dummy_prefix and not any(p.type == 4 for p in model.pieces)
        and all(len(LETTERS.findall(p.lstrip(SPACE))) <= 1 and SPACE not in p.lstrip(SPACE) and "\n" not in p for p in normal)
    )


def pre_tokens(text: str) -> list[str]:
    """The parts of a text; each starts with its spaces, the first with the one the model puts before."""
    return PRE_TOKEN.findall(" " + text.replace(SPACE, " ")) if text else []


def length(path: str, token: str) -> int:
    """Tokens of one pre-token: the library puts one space before, so one is left out."""
    processor = load(path)
    if token == "\n":
        return len(processor.encode("a\n")) - len(processor.encode("a"))
    if token[0] == " ":
        return len(processor.encode(token[1:])) if len(token) > 1 else len(processor.encode("a ")) - len(processor.encode("a"))
    return len(processor.encode("\n" + token)) - len(processor.encode("\n"))


class Lengths(dict):
    """Worker cache over the hot table: a miss is encoded and kept. A full cache becomes the older
    generation, from which what is still in use comes back; so at most twice CACHE entries are held."""

    def __init__(self, path: str, hot: dict[str, int]) -> None:
        super().__init__(hot)
        self.path, self.hot, self.older = path, hot, {}

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE + len(self.hot):
            self.older = dict(self)
            self.clear()
            self.update(self.hot)
        value = self.older.get(token)
        if value is None:
            value = length(self.path, token)
        self[token] = value
        return value


_workers: dict[tuple, Lengths] = {}


def _lookup(path: str, packed: tuple[str, bytes]) -> Lengths:
    key = (path, hash(packed[0]))
    if key not in _workers:
        _workers.clear()
        tokens = packed[0].split("\r") if packed[0] else []
        _workers[key] = Lengths(path, dict(zip(tokens, packed[1])))
    return _workers[key]


def hot_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, bytes]:
    """Frequent pre-tokens joined by carriage returns, and a byte each with their lengths.

    Counted on the bounded sample named above; it only decides what is looked up fast, never a result.
    """
    counts: Counter = Counter()
    rows = id_and_text(docs, id_col, text_col).where("_text IS NOT NULL")
    for r in sample_texts(rows, None, SAMPLE, SAMPLE_CHARS).select("t").toLocalIterator():
        counts.update(pre_tokens(r["t"]))
    best = [t for t, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:HOT] if n > 1 and "\r" not in t]
    lengths = [(t, length(path, t)) for t in best]
    kept = [(t, n) for t, n in lengths if n < 256]
    return "\r".join(t for t, _ in kept), bytes(n for _, n in kept)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(`_id`, `n_bytes`, `n_tokens`, `over_limit`) for every row, as the library counts without marks.

    Null and empty texts have no bytes and no tokens. Models whose counts do not add up over pre-tokens
    are encoded whole by the library. Repeated rows are counted each; other columns are not looked at; an
    empty table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    packed = docs.sparkSession.sparkContext.broadcast(hot_table(docs, path, id_col, text_col)) if splittable(path) else None

    def run(texts):
        if packed is None:
            tokens = [len(load(path).encode(t)) if t else 0 for t in texts]
        else:
            at = _lookup(path, packed.value).__getitem__
            tokens = [sum(map(at, pre_tokens(t))) if t else 0 for t in texts]
        return {"n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": tokens}

    return map_texts(rows, "n_bytes bigint, n_tokens bigint", run).withColumn("over_limit", F.col("n_tokens") > limit)
