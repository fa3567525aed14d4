"""Near copies against brute-force Jaccard."""

from __future__ import annotations

import random

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def brute_jaccard(docs, words=5):
    """Smallest id reachable over pairs with a Jaccard similarity of at least 0.8."""
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_components_equal_brute_force(spark, table, odd_texts):
    """Chains, dense groups around a template, other lengths, and pairs at 0.8 exactly and just below."""
    from tidegate.llm import jaccard

    rng = random.Random(8)
    texts = list(odd_texts)
    for n in (9, 14, 49, 120, 300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(25):
            made = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                made[rng.randrange(len(made))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(made[rng.randint(0, n // 12) : len(made) - rng.randint(0, n // 12)]))
    shared = [f"v{i}" for i in range(84)]
    texts += [" ".join(shared), " ".join(shared + [f"e{i}" for i in range(20)]), " ".join(shared + [f"f{i}" for i in range(21)])]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    got = {r["_id"]: r["_component"] for r in jaccard.near_copies(table([t for _, t in docs], [i for i, _ in docs])).collect()}
    want = brute_jaccard(docs)
    assert got == want and len(set(want.values())) > 10
    assert got[len(texts) - 2] == len(texts) - 3 and got[len(texts) - 1] == len(texts) - 1


def test_stage_drops_pairs_beyond_four_bits(spark):
    """Documents 1 and 177 of sf0.001 have a similarity of 0.83 and fingerprints nine bits apart."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    component = brute_jaccard([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == {i for i, low in component.items() if i == low} and 177 not in kept


def test_stage_takes_pairs_from_fingerprints(spark, monkeypatch):
    """The stage searches the fingerprints of all texts, and the pairs found connect what the radius connects."""
    from tidegate.llm import jaccard, simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, *rest: seen.append(distinct.count()) or links(distinct, *rest))
    rows = docs.selectExpr("xxhash64(text) AS key", "text AS _text")
    pairs = {(r["a"], r["b"]) for r in jaccard._alike(rows, 5).collect()}
    prints = {r["key"]: simhash.simhash(r["_text"], 5) & simhash.MASK for r in rows.collect()}
    assert seen == [len(set(prints.values()))]
    near = {(max(x, y), min(x, y)) for x in prints for y in prints if x != y and (prints[x] ^ prints[y]).bit_count() <= jaccard.RADIUS}
    assert pairs and pairs <= near
    root = {k: k for k in prints}
    for a, b in pairs:
        root = {k: root[b] if r == root[a] else r for k, r in root.items()}
    assert all(root[a] == root[b] for a, b in near)
    del seen[:]
    corpus_pipeline.near_dedup(spark, docs, SF).count()
    assert len(seen) == 1
