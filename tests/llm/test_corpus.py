"""Decontamination and substring dedup against brute force, and the pipeline stage by stage."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

import corpus_pipeline
from tests.compare import compare, connect
from tidegate.llm import decontam, queries, superkmer

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    assert compare(spark, connect(SF), SF, name) is None


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_leaks(docs, items):
    found = set()
    for i, d in docs:
        have = shingles(d)
        for j, t in items:
            want = shingles(t)
            if want and len(want & have) * 10 >= len(want) * 8:
                found.add((i, j, len(want), len(want & have)))
    return found


def test_contained_items(table, spark, odd_texts):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(25)]
    items = [(j, " ".join(rng.choice(words) for _ in range(n))) for j, n in enumerate([4, 5, 6, 9, 12, 14, 40])]
    docs = list(enumerate(odd_texts))
    for j, text in items:
        for cut in (0, 1, 2, 3):
            parts = text.split()
            docs.append((len(docs), " ".join([rng.choice(words) for _ in range(50)] + parts[: len(parts) - cut] + ["end"] * 30)))
            docs.append((len(docs), " ".join(parts[cut:] + [text.upper()][: cut == 2])))
    frame = table([t for _, t in docs], [i for i, _ in docs])
    bench = spark.createDataFrame([*((j, t, "x") for j, t in items), (98, None, "x"), (99, "", "x")], "item_id long, text string, _item string")
    got = {(r["_id"], r["_item"], r["n_item"], r["n_shared"]) for r in decontam.contaminated(frame, bench).collect()}
    assert got == brute_leaks(docs, items) and got
    assert {r["doc_id"] for r in decontam.clean(frame, bench).collect()} == {i for i, _ in docs} - {g[0] for g in got}
    assert decontam.contaminated(frame.limit(0), bench).count() == 0 == decontam.contaminated(frame, bench.limit(0)).count()


def brute_cut(docs, k):
    first, result = {}, {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    for i in sorted(words):
        for at in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][at : at + k]), (i, at))
    for i, w in words.items():
        gone = {p for at in range(len(w) - k + 1) if first[tuple(w[at : at + k])] != (i, at) for p in range(at, at + k)}
        result[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return result


@pytest.mark.parametrize("k", [4, 7])
@pytest.mark.parametrize("batch, bucket", [(50, 50), (400, 200), (10**7, 10**7)])
def test_repeats_equal_brute_force(spark, table, monkeypatch, k, batch, bucket):
    """Few words make many repeats, inside a document too; small batches make survivors meet again."""
    rng = random.Random(k)
    passages = [" ".join(rng.choice("abcde") for _ in range(rng.randint(3, 15))) for _ in range(10)]
    docs = [(3 * i - 20, "\n".join(rng.choice(passages) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    monkeypatch.setattr(superkmer, "BUCKET_BYTES", bucket)
    rows = [(i, 7, t) for i, t in docs]
    from tidegate.llm.superkmer import _in_buckets, _to_buckets  # the map and reduce sides without Spark
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(superkmer, "BATCH_BYTES", batch)
    rng.shuffle(rows)
    source = pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows]) for n in range(3)], names=["_id", "_key", "_text"])
    packed = [row for b in _to_buckets(k, 2, 5)(iter([source])) for row in b.to_pylist()]
    packed.sort(key=lambda r: r["bucket"])
    reduced = pa.RecordBatch.from_pylist(packed, pa.schema([("bucket", pa.int32()), ("packed", pa.binary())]))
    runs: dict = {}
    for b in _in_buckets(k, 2)(iter([reduced])):
        for r in b.to_pylist():
            runs.setdefault(r["_id"], []).append((r["start"], r["n"]))
    want = brute_cut(docs, k)
    for i, text in docs:
        n, gone, kept = superkmer.cut(text, [r[0] for r in runs.get(i, [])], [r[1] for r in runs.get(i, [])], k)
        assert (n, gone, kept.decode()) == want[i]
    assert np.any([w[1] for w in want.values()])


def test_repeats_odd_rows(table, odd_texts):
    passage = " ".join(f"p{i}" for i in range(25))
    texts = [*odd_texts, passage, f"a {passage} b", passage, passage]
    docs = list(enumerate(texts))
    repeated = table([*texts, passage, passage], [*range(len(texts)), len(texts) - 1, None])
    got = [(r["_id"], r["n_words"], r["n_removed"], r["kept"]) for r in superkmer.remove_repeats(repeated).collect()]
    want = brute_cut([(i, t) for i, t in docs] + [(-1, passage)], 20)
    want[None] = want.pop(-1)
    assert sorted(map(repr, got)) == sorted(map(repr, [(i, *w) for i, w in want.items()] + [(len(texts) - 1, *want[len(texts) - 1])]))
    assert superkmer.remove_repeats(repeated.limit(0)).count() == 0
    kept = {r["doc_id"]: r["text"] for r in superkmer.without_repeats(table(texts)).collect()}
    assert kept[1] == "" and kept[2] == odd_texts[2] and kept[len(odd_texts) + 1] == "a b" and len(texts) - 1 not in kept


def test_null_ids_and_clashing_names(spark):
    """Texts of rows without ids are documents of their own; columns with names used inside stay as they are."""
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(None, f"{n} x {passage} y{n}", n, [n]) for n in range(3)] + [(5, passage, 3, [3]), (None, "0 x " + passage + " y0", 4, [4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _starts int, _counts array<int>")
    got = {r["_starts"]: r for r in superkmer.without_repeats(docs).collect()}
    whole = [n for n in (0, 1, 2) if got[n]["text"] == rows[n][1]]
    assert len(whole) == 1 and all(got[n]["text"] == f"{n} y{n}" for n in (0, 1, 2) if n not in whole)
    assert 3 not in got and got[4]["text"] == got[0]["text"] and got[1]["_counts"] == [1]


def test_pipeline_stage_by_stage(spark):
    """Each stage against brute force on what the stage before kept."""
    from tests.llm.test_near_copies import brute_jaccard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        rows = made.collect()
        if name == "language_id":
            want = {i: t for i, t in kept.items() if t and re.search(r"[^\W\d_]", t)}
        elif name == "near_dedup":
            component = brute_jaccard(list(kept.items()))
            want = {i: t for i, t in kept.items() if component[i] == i}
        elif name == "substring_dedup":
            cut = brute_cut(list(kept.items()), 20)
            want = {i: t if not cut[i][1] else cut[i][2] for i, t in kept.items() if not cut[i][1] or cut[i][2]}
        elif name == "decontamination":
            leaks = {x[0] for x in brute_leaks(list(kept.items()), items)}
            want = {i: t for i, t in kept.items() if i not in leaks}
        else:
            import public_tokenizers
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert {r["doc_id"]: r["ids"] for r in rows} == {i: ",".join(map(str, library.encode(t))) for i, t in kept.items()}
            break
        assert made.columns == docs.columns and {r["doc_id"]: r["text"] for r in rows} == want
        docs, kept = spark.createDataFrame(rows, docs.schema), want
