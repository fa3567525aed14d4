"""Language, quality, licences, shards, tokens and pieces against brute force, libraries and held-out rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidegate.llm import langid, licences, ordinal, piece_bpe, queries, reshard, tokencount

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def rows(sql):
    return duckdb.sql(sql.replace("documents", f"'{SF}/documents.parquet'").replace("labels", f"'{SF}/labels.parquet'")).fetchall()


def test_phrases_are_the_longest_matches():
    rng = random.Random(2)
    sample = "".join(rng.choice("abc") for _ in range(60))
    nxt = langid.automaton(sample)
    for _ in range(300):
        text, at, want = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 25))), 0, 0
        while at < len(text):
            n = max((n for n in range(1, len(text) - at + 1) if text[at : at + n] in sample), default=1)
            at, want = at + n, want + 1
        assert langid.phrases(nxt, text) == want


def test_language_on_held_out_rows(spark):
    truth = dict(rows("SELECT doc_id, lang FROM documents"))
    got = {r["doc_id"]: r for r in queries.op2_language(spark, SF).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in truth}
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_odd_rows(table, odd_texts):
    langs = ["en", None, "de", "en", "fr", "en", "fr", "xx", "ja", "fr", "en"]
    docs = table(odd_texts, langs=langs)
    got = {r["_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 7, 8)] == ["und", "und", "und", "und", "ja"] and got[0]["score"] == 0
    assert sorted(r["doc_id"] for r in langid.keep_identified(docs).collect()) == [3, 4, 5, 6, 8, 9, 10]
    nothing = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), nothing).count() == 0


def test_quality_orders_grades(table, spark):
    rng = random.Random(1)
    vocabulary = [f"word{i}" for i in range(40)]
    marks = ["vile", "poor", "fine"]
    grades = [i % 3 for i in range(600)]
    texts = [" ".join([*(rng.choice(vocabulary) for _ in range(20)), marks[g]]) for g in grades]
    docs = table(texts)
    ratings = spark.createDataFrame([*((i, g) for i, g in enumerate(grades) if i < 450), (3, None), (9999, 1)], "doc_id long, grade int")
    model = ordinal.fit(docs, ratings, "grade", 3)
    got = {r["_id"]: r for r in ordinal.grade(docs, model).collect()}
    assert list(model.thresholds) == sorted(model.thresholds)
    right = sum((got[i]["tails"][0] >= 0.5) + (got[i]["tails"][1] >= 0.5) == grades[i] for i in range(450, 600))
    assert right >= 135
    assert all(r["tails"][0] >= r["tails"][1] and abs(sum(r["tails"]) - r["expected_grade"]) < 1e-9 for r in got.values())


def test_quality_odd_rows(table, odd_texts, spark):
    docs = table(odd_texts)
    none = ordinal.fit(docs, spark.createDataFrame([], "doc_id long, grade int"), "grade", 3)
    assert ordinal.grade(docs, none).count() == len(odd_texts) and not none.weights.any()
    assert ordinal.grade(docs.limit(0), none).count() == 0


def test_flow_is_cheapest():
    """Against all integral flows of small cases."""
    def best(supply, capacity, cost):
        def go(i, j, left, free):
            if i == len(supply):
                return 0
            if j == len(capacity) - 1:
                return left * cost[i][j] + go(i + 1, 0, supply[i + 1] if i + 1 < len(supply) else 0, [*free[:-1], free[-1] - left]) if left <= free[j] else 10**9
            return min(x * cost[i][j] + go(i, j + 1, left - x, [*free[:j], free[j] - x, *free[j + 1 :]]) for x in range(min(left, free[j]) + 1))
        return go(0, 0, supply[0], capacity)

    rng = random.Random(4)
    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 4) for _ in range(n)]
        capacity = [rng.randint(0, 5) for _ in range(m)]
        cost = [[rng.randint(0, 5) for _ in range(m)] for _ in range(n)]
        if sum(capacity) < sum(supply):
            with pytest.raises(ValueError):
                reshard.min_cost_flow(supply, capacity, cost)
            continue
        flow = reshard.min_cost_flow(supply, capacity, cost)
        assert [sum(f) for f in flow] == supply and all(sum(f[j] for f in flow) <= capacity[j] for j in range(m))
        assert sum(flow[i][j] * cost[i][j] for i in range(n) for j in range(m)) == best(supply, capacity, cost)


def test_shards_have_equal_bytes_and_gapless_slots(spark):
    texts = dict(rows("SELECT doc_id, text FROM documents"))
    got = queries.op5_reshard(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    shards = {s: [r for r in got if r["shard"] == s] for s in range(8)}
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in shards.values())
    bytes_ = [sum(r["size"] for r in x) for x in shards.values()]
    assert max(bytes_) - min(bytes_) < 0.05 * sum(bytes_) / 8
    old = [sum(r["size"] for r in got if r["old_shard"] == i) for i in range(6)]
    least = sum(max(0, o - sum(old) / 8) for o in old)
    assert sum(r["size"] for r in got if r["shard"] != r["old_shard"]) <= least + 0.05 * sum(old)


def test_shards_odd_rows(table, odd_texts):
    docs = table([*odd_texts, "x"], [*range(len(odd_texts)), None])
    got = reshard.placement(docs.drop("shard").withColumn("old", docs["n_chars"] % 2), "old", 3, weights=[1, 0, 2]).collect()
    assert len(got) == len(odd_texts) + 1 and all(r["shard"] in (0, 1, 2) for r in got)
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert reshard.placement(docs.limit(0), "shard", 3).count() == 0


def test_only_affected_files_are_rewritten(spark, table, tmp_path):
    docs = table([f"text {i} " * (i % 7) for i in range(200)]).withColumn("old", F.pmod("doc_id", F.lit(2)))
    placed = reshard.placement(docs, "old", 3, blocks=8)
    reshard.write_layout(docs, "old", str(tmp_path / "a"), blocks=8)
    moves = placed.select("old_shard", "block", "shard").distinct()
    reshard.rewrite(spark, str(tmp_path / "a"), str(tmp_path / "b"), moves)
    moved = {(r["_shard"], r["doc_id"]) for r in spark.read.parquet(str(tmp_path / "b")).collect()}
    assert moved == {(r["shard"], r["_id"]) for r in placed.where("shard <> old_shard").collect()} and moved


def test_licences_equal_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.op6_licences(spark, SF).collect()}
    for i, text in rows("SELECT doc_id, text FROM documents"):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(at, label) for phrase, label in licences.BASE.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted({p[1] for p in places})))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


@pytest.mark.parametrize("expression, ids, ok", [
    ("MIT", {"mit"}, True),
    ("GPL-2.0-only OR MIT", {"gpl-2.0-only", "mit"}, True),
    ("GPL-2.0-only AND MIT", {"gpl-2.0-only", "mit"}, False),
    ("MIT OR GPL-2.0-only AND GPL-3.0-only", {"mit", "gpl-2.0-only", "gpl-3.0-only"}, True),
    ("(MIT OR GPL-2.0-only) AND GPL-3.0-only", {"mit", "gpl-2.0-only", "gpl-3.0-only"}, False),
    ("Apache-2.0 WITH LLVM-exception and mit", {"apache-2.0", "mit"}, True),
    ("MIT */", {"mit"}, True),
])
def test_licence_expressions(expression, ids, ok):
    assert licences.evaluate(licences.to_postfix(expression)) == (ids, ok)


@pytest.mark.parametrize("expression", ["", "AND MIT", "MIT OR", "(MIT", "()", "MIT AND (OR GPL)"])
def test_malformed_expressions(expression):
    assert licences.to_postfix(expression) is None


def test_licences_odd_rows(table, odd_texts):
    texts = [*odd_texts, "x\n// SPDX-License-Identifier: GPL-3.0-only OR MIT\nUnder the  MIT-license, under THE mit license", "under the mit license under the mit license"]
    got = {r["_id"]: r for r in licences.scan(table(texts)).collect()}
    tagged, twice = got[len(odd_texts)], got[len(odd_texts) + 1]
    assert tagged["labels"] == "gpl-3.0-only,mit" and tagged["permitted"] and tagged["n_base"] == 2 and tagged["score"] == 1
    assert (twice["n_base"], twice["first_word"], twice["last_word"]) == (2, 0, 4)
    assert (got[0]["n_words"], got[0]["labels"], got[0]["permitted"]) == (0, "", None)
    assert licences.scan(table(texts).limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_tokens_equal_the_library(spark, library):
    texts = dict(rows("SELECT doc_id, text FROM documents"))
    counts = {r["doc_id"]: r for r in queries.op8_token_counts(spark, SF).collect()}
    pieces = {r["doc_id"]: r for r in queries.op9_sentencepiece(spark, SF).collect()}
    for i, text in texts.items():
        ids = library.encode(text)
        assert (counts[i]["n_bytes"], counts[i]["n_tokens"], counts[i]["over_limit"]) == (len(text.encode()), len(ids), len(ids) > 4096)
        assert pieces[i]["n_tokens"] == len(ids)
        assert pieces[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert pieces[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_random_texts(library):
    rng, bpe, lengths = random.Random(1), piece_bpe.load(MODEL), tokencount.Lengths(MODEL, {})
    letters = "²³½abé ▁\n\t  .,'\"<>/s#$%019中文日😀Ωжы 　\x00​()[]{}_-=+:;ﷺ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += ["", " ", "\n", " " * 300, "ab" * 2000, "<s>a</s>", "<0x0A>", open(__file__, encoding="utf8").read()]
    for text in texts:
        ids = library.encode(text)
        assert bpe.encode(text) == ids and bpe.round_trip(text)[2] == library.decode(ids) == bpe.decode(ids)
        assert sum(map(lengths.__getitem__, tokencount.pre_tokens(text))) == len(ids)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(0, 10))]
        assert bpe.decode(ids) == library.decode(ids)


def test_tokens_odd_rows(table, odd_texts, library):
    docs = table(odd_texts)
    counts = {r["_id"]: r["n_tokens"] for r in tokencount.token_counts(docs, MODEL).collect()}
    made = {r["_id"]: r for r in piece_bpe.encode_decode(docs, MODEL).collect()}
    for i, text in enumerate(odd_texts):
        ids = library.encode(text or "")
        assert counts[i] == made[i]["n_tokens"] == len(ids) and made[i]["ids"] == ",".join(map(str, ids))
    assert tokencount.token_counts(docs.limit(0), MODEL).count() == 0 and piece_bpe.encode_decode(docs.limit(0), MODEL).count() == 0


def test_a_long_text_full_of_licence_phrases():
    """Time is linear to the text: 60,000 places, some of phrases within each other."""
    import time

    words = ["cc", "by", "nc", "under", "the", "mit", "license"] * 60_000
    begun = time.time()
    found = licences.Scanner.scan(" ".join(words))
    places = [i for i in range(len(words)) if words[i : i + 3] == ["cc", "by", "nc"] or words[i : i + 4] == ["under", "the", "mit", "license"]]
    assert (found["n_base"], found["first_word"], found["last_word"]) == (len(places), min(places), max(places)) and time.time() - begun < 10


def test_wrong_ids_show_in_the_decoded_text():
    """The digest is made of what the ids say: ids of another piece decode to its text."""
    bpe = piece_bpe.PieceBpe(MODEL)
    bpe.ids = bpe.ids | {"▁the": bpe.ids["▁of"]}
    assert bpe.round_trip("the cat")[2] == "of cat"


def test_repeated_ids_are_rated_once(table, spark):
    texts = [f"fine word{i % 7}" if i % 2 else f"vile word{i % 5}" for i in range(40)] + ["vile again"] * 200
    ids = [*range(40), *([1] * 200)]
    ratings = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, grade int")
    model = ordinal.fit(table(texts, ids), ratings, "grade", 2)
    got = {r["_id"]: r["tails"][0] for r in ordinal.grade(table(texts[:40]), model).collect()}
    assert all((p >= 0.5) == bool(i % 2) for i, p in got.items())
