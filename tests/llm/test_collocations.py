"""Collocations against brute force; the query's oracle is compared with the others."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from tidegate.llm import collocate


def brute(docs, least, top, longest, share=100):
    found, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                found[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in found.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p in candidates for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * f[p] >= share * f[p[i : i + k]]}
        rows = []
        for p in candidates.keys() - gone:
            score, k = min((1000 * f[p] * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top, longest, share, batch, hot", [
    (2, 1000, 5, 100, 10**7, 1000), (3, 7, 4, 60, 300, 10), (1, 50, 3, 100, 100, 5), (2, 9, 2, 100, 500, 10**6),
])
def test_equal_to_brute_force(table, odd_texts, monkeypatch, least, top, longest, share, batch, hot):
    """Small batches and hot prefixes change nothing; ties are everywhere."""
    monkeypatch.setattr(collocate, "HOT", hot)
    rng = random.Random(least)
    words = ["a", "A", "b", "of", "Of", "the", "é", "É", "日本", "x'y", "a b", "\x1c"]
    texts = list(odd_texts)
    for _ in range(60):
        texts.append("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ". ", "\n", ",", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 30))))
    langs = [rng.choice(["en", "en", "de", None, "und", ""]) for _ in texts]
    docs = table(texts, langs=langs)
    got = [tuple(r) for r in collocate.collocations(docs, least, top, longest, share, batch_bytes=batch).collect()]
    assert sorted(got) == brute(zip(langs, texts), least, top, longest, share) and got
    assert collocate.collocations(docs.limit(0), least).count() == 0


def test_scores_beyond_64_bits(spark):
    """The division is exact where products pass 64 bits."""
    from decimal import Decimal

    from pyspark.sql import functions as F

    rows = spark.range(1).select(*(F.lit(Decimal(v)).cast("decimal(38,0)").alias(k) for k, v in (("above", 1000 * 10**12 * 10**13 - 1), ("below", 10**12 * 10**6))))
    assert rows.select(F.expr("above div below").alias("q")).first()["q"] == (1000 * 10**25 - 1) // 10**18
