"""SimHash components and order MinHash against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest
import xxhash

from tidegate.llm import graph, orderminhash, queries, simhash

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=4):
    up = {i: i for i in values}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(values)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_query_equals_brute_force(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    want = {i: fingerprint(t) for i, t in texts.items()}
    got = {r["doc_id"]: r for r in queries.op1_simhash(spark, SF).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{v:016x}" for i, v in want.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(want)


@pytest.mark.parametrize("agree", [1, 2])
@pytest.mark.parametrize("tree_size", [5, 4096])
def test_links_connect_what_the_radius_connects(spark, agree, tree_size):
    """Chains within the radius, a dense group, far values; trees so small that shards need several."""
    rng = random.Random(7)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(150):
        v = rng.choice(values)
        for _ in range(rng.randint(1, 5)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values} | {0, -1})
    frame = spark.createDataFrame([(v,) for v in values], "_fp long")
    links = simhash.links(frame, agree=agree, tree_size=tree_size)
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    want = brute_components({v: v & simhash.MASK for v in values})
    for v in values:
        assert want[got.get(v, v)] == want[v]
    assert len({got.get(v, v) for v in values}) == len(set(want.values()))


def test_components_of_a_long_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(chain).collect()}
    assert got == {**{i: 0 for i in range(301)}, 500: 500, 501: 500}
    assert graph.components(chain.limit(0)).count() == 0


def test_tree_follows_enough_edges():
    rng = random.Random(3)
    values = list({rng.getrandbits(10) for _ in range(300)})
    tree = simhash.BkTree()
    for v in values:
        tree.add(v)
    for q in range(0, 1024, 7):
        assert sorted(tree.values[i] for i in tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_simhash_odd_rows(table, odd_texts):
    docs = table([*odd_texts, "a"], [*range(len(odd_texts)), None])
    got = [(r["_id"], r["_component"]) for r in simhash.near_duplicates(docs, tree_size=3).collect()]
    of = {i: c for i, c in got if i is not None}
    assert len(got) == len(odd_texts) + 1 and {of[0], of[1], of[2], of[7]} == {0} and of[6] == of[4] == 4
    assert dict(got)[None] == 3
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect() if r["doc_id"] is not None) == sorted(set(of.values()))


def test_order_minhash(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    got = {r["doc_id"]: r for r in queries.op10_order_minhash(spark, SF).collect()}
    by_text = {}
    for n, (i, text) in enumerate(rows):
        follows, half = rows[(n + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.9 * len(got)


def signature(spark_text):
    """Order MinHash of one text, step by step."""
    def hashed(values):
        h = 42
        for v in values:
            data = v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little") if not isinstance(v, tuple) else v[0].to_bytes(4, "little")
            h = xxhash.xxh64_intdigest(data, h)
        return h

    words = [hashed([w]) for w in re.split(r"\s+", spark_text) if w]
    low = (1 << orderminhash.HASH_BITS) - 1
    kmers = [hashed(words[i : i + 3]) & low for i in range(max(1, len(words) - 2))] if words else []
    seen, drawn = {}, {}
    for place, h in enumerate(kmers):
        seen[h] = seen.get(h, -1) + 1
        numbered = hashed([h, (seen[h],)]) & low
        drawn.setdefault(numbered >> (orderminhash.HASH_BITS - orderminhash.DRAW_BITS), []).append((numbered, place))
    out = []
    for d in range(orderminhash.DRAWS):
        best = sorted(sorted(drawn.get(d, []))[:2], key=lambda x: x[1])
        out.append(hashed([h for h, _ in best]) & 0xFFFF if best else -1)
    return out


def test_signature_is_order_minhash(spark, table):
    rng = random.Random(5)
    texts = ["", "a", "a b", "a b c", "a a a a a a", " ".join(rng.choice("abcdef") for _ in range(300)), " ".join(str(rng.random()) for _ in range(400))]
    got = {r["_id"]: r["_sig"] for r in orderminhash.fingerprints(table(texts)).select("_id", "_sig").collect()}
    for i, text in enumerate(texts):
        assert got[i] == signature(text), text[:20]


def test_next_document_over_blocks(spark, table, odd_texts):
    texts = [f"t{i}" for i in range(40)]
    rows = orderminhash.id_and_text(table(texts, [3 * i for i in range(40)]), "doc_id", "text")
    for size in (1, 3, 7, 100):
        got = {r["_id"]: r["_next"]["_id"] for r in orderminhash.with_next(rows, size).collect()}
        assert got == {3 * i: 3 * ((i + 1) % 40) for i in range(40)}
    odd = table([*odd_texts, "n", "same"], [*range(len(odd_texts)), None, 3])
    found = orderminhash.neighbour_edits(odd).collect()
    assert len(found) == len(odd_texts) + 2
    assert orderminhash.neighbour_edits(odd.limit(0)).count() == 0
    one = orderminhash.neighbour_edits(table(["abcd"])).first()
    assert one["_edited"] == "abab"
