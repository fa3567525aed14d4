from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, _fp string, shard string"


@pytest.fixture
def table(spark):
    """Documents with more columns than any operator looks at, some with names the operators use inside."""

    def make(texts, ids=None, langs=None):
        ids = ids if ids is not None else range(len(texts))
        langs = langs if langs is not None else ["en"] * len(texts)
        rows = [(i, t, lang, None, len(t or ""), "x", "y", "z", "w") for i, t, lang in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make


@pytest.fixture
def odd_texts():
    """Null, empty, white space, short, very long, repeated, other scripts."""
    return [None, "", " \n\t ", "a", "one two three", "word " * 30_000, "one two three", None, "日本語 テキスト", "é" * 500, "x" * 40_000]
