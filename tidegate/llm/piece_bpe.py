"""Exact merge-type encoding by backtracking, and decoding, for SentencePiece BPE models.

The merges of a pre-token give the only sequence of pieces in which every two neighbours are what merging
their joined text again gives. So the encoder goes left to right over the longest matches that an
Aho-Corasick automaton finds, tests each new piece against the one before (tests are remembered), and on
failure goes back to the next shorter match; a bitfield marks positions from which no way leads on, so
none is tried twice.
"""

from __future__ import annotations


import ahocorasick
from pyspark.sql import DataFrame

from tidegate.llm.common import id_and_text, map_texts, worker_cache
from tidegate.llm.tokencount import PRE_TOKEN, SPACE, splittable

#: Remembered pair tests; and pre-tokens after which a worker's cache starts anew, with the last one beside it.
PAIRS = 300_000
CACHE = 180_000


class PieceBpe:
    """The pieces of one model: encodes and decodes whole texts as the library does."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        if not splittable(path):
            raise ValueError(f"not a plain BPE model with a space mark: {path}")
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.unknown = self.types.index(2)
        self.unknown_text = model.trainer_spec.unk_surface
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.automaton = ahocorasick.Automaton()
        #: For each piece its next shorter piece with the same start.
        self.shorter: dict[str, str] = {}
        for piece in self.ids:
            if len(piece) == 1 or self.merged(piece) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        for piece in self.automaton.keys():
            for n in range(len(piece) - 1, 0, -1):
                if piece[:n] in self.automaton:
                    self.shorter[piece] = piece[:n]
                    break
        #: The text of each id that is neither a byte nor, in front of a text, cut.
        self.plain = [
            None if kind == 6 else "" if kind == 3 else self.unknown_text if kind == 2 else piece.replace(SPACE, " ")
            for piece, kind in zip(self.pieces, self.types)
        ]
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Ids joined by commas and text decoded from the ids, of pre-tokens met lately and before. Two tables of plain
        #: strings each: the garbage collector walks over tuples, and joins read them without a step of Python.
        self.ids_of: dict[str, str] = {}
        self.text_of: dict[str, str] = {}
        self.older: tuple[dict[str, str], dict[str, str]] = ({}, {})

    def merged(self, text: str) -> list[str]:
        """Merging by the rule itself: the neighbours whose joined piece scores best, leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the joined text of two pieces gives these two again."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def split(self, text: str) -> list[str]:
        """Pieces of one pre-token (space marks in place); characters without a piece stand alone."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, piece in self.automaton.iter(text):
            longest[end - len(piece) + 1] = piece
        failed, shorter, pairs = 0, self.shorter, self.pairs
        out: list[str] = []
        at, piece = 0, longest[0] or text[0]
        while True:
            end = at + len(piece)
            fits = True
            if failed >> end & 1:
                fits = False
            elif out:
                fits = pairs.get((out[-1], piece))
                if fits is None:
                    fits = self.compatible(out[-1], piece)
            if fits:
                out.append(piece)
                at = end
                if at == n:
                    return out
                piece = longest[at] or text[at]
                continue
            piece = shorter.get(piece)
            while piece is None:  # nothing fits here behind the piece before: that one goes
                if not out:
                    raise AssertionError("a text always has its merged pieces")
                failed |= 1 << at
                last = out.pop()
                at -= len(last)
                piece = shorter.get(last)

    def _learn(self, token: str) -> None:
        """Enters a pre-token; there is at least one id."""
        known = self.older[0].get(token)
        if known is not None:
            self.ids_of[token], self.text_of[token] = known, self.older[1][token]
            return
        ids = []
        for piece in self.split(token.replace(" ", SPACE)):
            number = self.ids.get(piece)
            if number is not None:
                ids.append(number)
            elif self.bytes:
                ids += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
            else:
                ids.append(self.unknown)
        decoded = self._text(ids, False)
        self.ids_of[token] = ",".join(map(str, ids))
        self.text_of[token] = token if decoded == token else decoded

    def round_trip(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, all ids joined by commas, the text decoded from them) of a whole text."""
        if not text:
            return 0, "", ""
        if len(self.ids_of) >= CACHE:
            self.older = self.ids_of, self.text_of
            self.ids_of, self.text_of = {}, {}
        tokens = PRE_TOKEN.findall(" " + text.replace(SPACE, " "))
        for token in set(tokens).difference(self.ids_of):
            self._learn(token)
        ids = ",".join(map(self.ids_of.__getitem__, tokens))
        return ids.count(",") + 1, ids, "".join(map(self.text_of.__getitem__, tokens))[1:]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, without begin or end; none for null and empty texts."""
        joined = self.round_trip(text)[1]
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: bytes are put together, bytes that are no UTF-8 become U+FFFD each, control ids
        have no text, unknown ones the model's mark; one space before the text is left out."""
        return self._text(ids, True)

    def _text(self, ids: list[int], first: bool) -> str:
        """`first` says whether the ids begin a text."""
        if not first:
            parts = [self.plain[i] for i in ids]
            if None not in parts:
                return "".join(parts)
        out: list[str] = []
        held = bytearray()

        def settle() -> None:
            at = 0
            while at < len(held):
                for n in (4, 3, 2, 1):
                    try:
                        char = bytes(held[at : at + n]).decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    if len(char) == 1:
                        out.append(char)
                        at += len(char.encode("utf-8"))
                        break
                else:
                    out.append("�")
                    at += 1
            held.clear()

        for i in ids:
            kind = self.types[i]
            if kind == 6:
                held.append(self.byte_of[i])
                first = False
                continue
            settle()
            if kind == 3:
                continue
            piece = self.unknown_text if kind == 2 else self.pieces[i].replace(SPACE, " ")
            out.append(piece[1:] if first and piece[:1] == " " and kind == 1 else piece)
            first = False
        settle()
        return "".join(out)


@worker_cache
def load(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`_id`, `n_tokens`, `ids` joined by commas, `decoded`) for every row, as the library does.

    Null and empty texts have no ids and decode to the empty text. Texts of any length are encoded whole,
    with a worker cache of bounded size. Repeated rows are encoded each; other columns are not looked at;
    an empty table gives no rows.
    """

    def run(texts):
        bpe = load(path)
        made = [bpe.round_trip(t) for t in texts]
        return {"n_tokens": [m[0] for m in made], "ids": [m[1] for m in made], "decoded": [m[2] for m in made]}

    return map_texts(id_and_text(docs, id_col, text_col), "n_tokens bigint, ids string, decoded string", run)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`_id`, `n_tokens`, `ids_sha256`, `decoded_sha256`): digests of what `encode_decode` returns, made
    beside it so that ids and texts need not leave the worker."""
    from hashlib import sha256

    def run(texts):
        bpe = load(path)
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in texts:
            n, ids, decoded = bpe.round_trip(t)
            out["n_tokens"].append(n)
            out["ids_sha256"].append(sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
        return out

    return map_texts(id_and_text(docs, id_col, text_col), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", run)
