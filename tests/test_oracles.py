"""Every registered query beside its oracle, at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_oracle(spark, db, name):
    fault = compare(spark, db, SF, name)
    assert fault is None, fault


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
