"""Byte-level BPE encoding and decoding with an index of pair occurrences.

The new pre-tokens of a batch lie, some thousands at a time, in one row of symbols, borders between them unlinked. An index maps each
mergeable pair to all its places in that row. Active ranks are taken in ascending order; a rank is applied
at all its places from left to right, and only the lists of the pairs beside a merge are touched. A merge
that makes a pair of a lower rank puts the rest of its list back, so each pre-token sees its merges in the
order the rule asks for: lowest rank first, leftmost first. Encoded pre-tokens are kept in the worker.
"""

from __future__ import annotations

import json
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame

from tidegate.llm.common import id_and_text, map_texts, worker_cache

#: Pre-tokens in each of the two generations of a worker's cache; longer ones (in characters) are not kept.
CACHE = 250_000
KEPT_CHARS = 200
#: Pre-tokens in one index: more of them leave the processor's cache and take three times as long each.
INDEXED = 2000
#: The split of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_signs() -> list[str]:
    """The printable character that stands for each byte: itself if it shows, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class ByteBpe:
    """One byte-level model: encodes and decodes whole texts as the tokenizer library does."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, before = told["model"], told["pre_tokenizer"] or {}
        plain = (
            model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and told["normalizer"] is None
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("byte_fallback")
            and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
            and (told["decoder"] or {}).get("type") == "ByteLevel"
            and not any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in told["added_tokens"])
        )
        if not plain:
            raise ValueError(f"not a plain byte-level BPE model: {path}")
        vocab, signs = model["vocab"], byte_signs()
        self.base = np.array([vocab[s] for s in signs])
        byte_of = {s: b for b, s in enumerate(signs)}
        self.special = {a["content"]: a["id"] for a in told["added_tokens"]}
        self.data = {i: bytes(map(byte_of.__getitem__, t)) for t, i in vocab.items() if t not in self.special}
        self.data |= {i: t.encode() for t, i in self.special.items()}
        self.shift = max(self.data).bit_length()
        self.rank: dict[int, int] = {}
        self.parts: list[tuple[int, int, int]] = []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[left] << self.shift | vocab[right]] = len(self.parts)
            self.parts.append((vocab[left], vocab[right], vocab[left + right]))
        #: Ranks of pairs of bytes, -1 where there is none.
        self.first_rank = np.array([self.rank.get(int(a) << self.shift | int(b), -1) for a in self.base for b in self.base])
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.split = regex.compile(SPLIT).findall
        #: Ids joined by commas and bytes decoded from the ids, of pre-tokens met lately and before. Two tables of
        #: plain strings each: the garbage collector walks over tuples, and joins read them without a step of Python.
        self.older: tuple[dict[str, str], dict[str, bytes]] = ({}, {})
        self._turn()

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, by the index of pair occurrences over all of them."""
        rank, shift = self.rank, self.shift
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        links = np.arange(1, len(data) + 1)
        links[ends[ends > 0] - 1] = -1
        first = self.first_rank[data[:-1].astype(np.int64) << 8 | data[1:]] if len(data) > 1 else np.zeros(0, np.int64)
        found = np.flatnonzero((first >= 0) & (links[:-1] >= 0))
        found = found[np.argsort(first[found], kind="stable")]
        active, edges = np.unique(first[found], return_index=True)
        active, edges = active.tolist(), [*edges.tolist(), len(found)]
        found = found.tolist()
        places = {r: found[a:b] for r, a, b in zip(active, edges, edges[1:])}
        # one symbol more than there are bytes: what -1 leads to
        symbols = [*self.base[data].tolist(), -1]
        after = links.tolist()
        before = np.where(np.concatenate([[-1], links[:-1]]) < 0, -1, np.arange(-1, len(data) - 1)).tolist() if len(data) else []
        while active:
            r = heappop(active)
            todo = places.pop(r)
            todo.sort()
            left, right, whole = self.parts[r]
            for done, at in enumerate(todo, 1):
                then = after[at]
                if symbols[then] != right or symbols[at] != left:
                    continue
                symbols[at], symbols[then] = whole, -1
                after[at] = beyond = after[then]
                lower = False
                if beyond >= 0:
                    before[beyond] = at
                    made = rank.get(whole << shift | symbols[beyond])
                    if made is not None:
                        lower |= made < r
                        if made in places:
                            places[made].append(at)
                        else:
                            places[made] = [at]
                            heappush(active, made)
                ahead = before[at]
                if ahead >= 0:
                    made = rank.get(symbols[ahead] << shift | whole)
                    if made is not None:
                        lower |= made < r
                        if made in places:
                            places[made].append(ahead)
                        else:
                            places[made] = [ahead]
                            heappush(active, made)
                if lower and done < len(todo):
                    places[r] = todo[done:]
                    heappush(active, r)
                    break
        left_over = [x for x in symbols if x >= 0]
        counts = np.concatenate([[0], np.cumsum(np.array(symbols[:-1], np.int64) >= 0)])[ends].tolist() if len(data) else [0] * len(words)
        return [left_over[a:b] for a, b in zip([0, *counts], counts)]

    def _turn(self) -> None:
        self.ids_of = {t: str(i) for t, i in self.special.items()}
        self.data_of = {t: self.data[i] for t, i in self.special.items()}

    def _learn(self, tokens: set[str]) -> None:
        new, (ids_then, data_then) = [], self.older
        for t in tokens:
            known = ids_then.get(t)
            if known is None:
                new.append(t)
            else:
                self.ids_of[t], self.data_of[t] = known, data_then[t]
        for at in range(0, len(new), INDEXED):
            part = new[at : at + INDEXED]
            for token, ids in zip(part, self.merged([t.encode("utf-8", "surrogatepass") for t in part])):
                self.ids_of[token] = ",".join(map(str, ids))
                self.data_of[token] = b"".join(map(self.data.__getitem__, ids))

    def round_trips(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, all ids joined by commas, the text decoded from them) of each whole text."""
        cut: list[list[str]] = []
        for text in texts:
            if not text:
                cut.append([])
            elif self.marks is None or not self.marks.search(text):
                cut.append(self.split(text))
            else:
                cut.append([t for i, part in enumerate(self.marks.split(text)) for t in ([part] if i % 2 else self.split(part))])
        if len(self.ids_of) >= CACHE:
            self.older = self.ids_of, self.data_of
            self._turn()
        fresh = set().union(*cut).difference(self.ids_of)
        self._learn(fresh)
        out = []
        for tokens in cut:
            # a pre-token has at least one id
            ids = ",".join(map(self.ids_of.__getitem__, tokens))
            decoded = b"".join(map(self.data_of.__getitem__, tokens)).decode("utf-8", "replace")
            out.append((ids.count(",") + 1 if ids else 0, ids, decoded))
        for t in fresh:
            if len(t) > KEPT_CHARS:
                del self.ids_of[t], self.data_of[t]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; strings of special tokens become their ids, nothing is added."""
        joined = self.round_trips([text])[0][1]
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        """Text of any known ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.data.__getitem__, ids)).decode("utf-8", "replace")


@worker_cache
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`_id`, `n_tokens`, `ids` joined by commas, `decoded`) for every row, as the library does.

    Null and empty texts have no ids and decode to the empty text. Texts of any length are encoded whole;
    repeated rows are encoded each; other columns are not looked at; an empty table gives no rows.
    """

    def run(texts):
        made = load(path).round_trips(texts)
        return {"n_tokens": [m[0] for m in made], "ids": [m[1] for m in made], "decoded": [m[2] for m in made]}

    return map_texts(id_and_text(docs, id_col, text_col), "n_tokens bigint, ids string, decoded string", run)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`_id`, `n_tokens`, `ids_sha256`, `decoded_sha256`): digests of what `encode_decode` returns, made
    beside it so that ids and texts need not leave the worker."""

    def run(texts):
        made = load(path).round_trips(texts)
        return {
            "n_tokens": [m[0] for m in made],
            "ids_sha256": [sha256(m[1].encode()).hexdigest() for m in made],
            "decoded_sha256": [sha256(m[2].encode("utf-8", "surrogatepass")).hexdigest() for m in made],
        }

    return map_texts(id_and_text(docs, id_col, text_col), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", run)
