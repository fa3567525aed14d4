"""Byte-level BPE against the tokenizer library and against merging by the rule itself."""

from __future__ import annotations

import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegate.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(MODEL)


def test_query_equals_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        told = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(told.encode()).hexdigest()


def test_odd_texts(table, odd_texts, library):
    texts = [*odd_texts, "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "it's  I'LL \t\n x", " " * 300, "ab" * 5000]
    got = {r["_id"]: r for r in byte_bpe.encode_decode(table(texts), MODEL).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids"]) == (len(ids), ",".join(map(str, ids)))
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False) == (text or "")
    assert byte_bpe.digests(table([]), MODEL).count() == 0


def test_every_character_and_any_ids(library):
    bpe, rng = byte_bpe.load(MODEL), random.Random(3)
    chars = [chr(i) for i in [*range(1, 0x3000), *range(0x1F000, 0x1FB00), *range(0xE000, 0xE010)]]
    texts = [f"a{c}b {c}1 {c}{c}\t{c} x" for c in chars]
    made = bpe.round_trips(texts)
    assert [m[1] for m in made] == [",".join(map(str, e.ids)) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [m[2] for m in made] == texts
    for _ in range(500):
        ids = [rng.randrange(50_257) for _ in range(12)]
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_merges_of_any_order(tmp_path):
    """Merge tables in which a merge makes pairs of lower ranks, against the rule applied word by word."""
    rng = random.Random(5)
    signs = byte_bpe.byte_signs()
    told = json.loads(open(MODEL, encoding="utf-8").read())
    for round_ in range(30):
        pairs, known = [], list("abc")
        for _ in range(14):
            left, right = rng.choice(known), rng.choice(known)
            if (left, right) not in pairs and len(left + right) < 9:
                pairs.append((left, right))
                known.append(left + right)
        rng.shuffle(pairs)
        vocab = {t: i for i, t in enumerate(dict.fromkeys([*signs, *known]))}
        path = tmp_path / f"{round_}.json"
        path.write_text(json.dumps(told | {"added_tokens": [], "model": told["model"] | {"vocab": vocab, "merges": [list(p) for p in pairs]}}))
        bpe = byte_bpe.ByteBpe(str(path))
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(40)]
        for word, ids in zip(words, bpe.merged([w.encode() for w in words])):
            parts = list(word)
            while True:
                best = min(((pairs.index((x, y)), i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if (x, y) in pairs), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
            assert ids == [vocab[p] for p in parts]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))
