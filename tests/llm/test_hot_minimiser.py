"""A phrase whose low hash makes it the minimiser of many different windows."""

from __future__ import annotations

import random

import pytest

from tests.llm.test_corpus import brute_cut
from tidegate.llm import superkmer


def _docs():
    """One phrase in all texts in other contexts; every tenth text also holds an earlier passage around it."""
    rng = random.Random(4)
    letters = [f"w{i}" for i in range(2000)]
    phrases = [" ".join(rng.sample(letters, 3)) for _ in range(3000)]
    from xxhash import xxh64_intdigest
    import numpy as np

    def low(phrase):
        hashes = np.array([xxh64_intdigest(w.encode(), superkmer.SEED) for w in phrase.split()], np.uint64)
        gram = superkmer._combined(hashes, 3)[0]
        return int(gram ^ (gram >> np.uint64(31)))

    phrase = min(phrases, key=low)
    around = lambda: " ".join(rng.choice(letters) for _ in range(25))
    docs = [(i, f"{around()} {phrase} {around()}") for i in range(200)]
    return [(i, t if i % 10 else f"{t} end {docs[0][1]}") for i, t in docs]


@pytest.mark.parametrize("heavy", [100, 10**9])
def test_hot_minimiser_is_split(spark, table, monkeypatch, heavy):
    monkeypatch.setattr(superkmer, "HEAVY", heavy)
    docs = _docs()
    rows = table([t for _, t in docs], [i for i, _ in docs])
    texts = rows.selectExpr("doc_id AS _id", "CAST(0 AS BIGINT) AS _key", "text AS _text")
    hot = superkmer._heavy(texts.select("_text"), 20, 3)
    assert (hot is None) == (heavy > 100)
    load: dict = {}
    for r in texts.mapInArrow(superkmer._to_buckets(20, 3, 1 << 20, hot), "bucket int, packed binary").collect():
        kind, numbers, _ = superkmer._unpack(r["packed"])
        load[r["bucket"]] = load.get(r["bucket"], 0) + int(numbers[:, 3].sum()) * kind
    assert (max(load.values()) > 2000) == (heavy > 100) and (heavy > 100 or max(load.values()) < 400)
    got = {r["_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in superkmer.remove_repeats(rows).collect()}
    assert got == brute_cut(docs, 20) and any(x[1] for x in got.values())
