"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from spanloom.plans.registry import load_all
from oracle import duck, duck_rows, spark_rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = load_all().queries, load_all().oracles
ROWS_ONLY: set[str] = set()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not mounted")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_only_sequential_operators_lack_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    spark_columns, got = spark_rows(QUERIES[name](spark, SF_DIR))
    duck_columns, expected = duck_rows(con, ORACLES[name])
    assert spark_columns == duck_columns
    assert got == expected
    assert got, "an empty result checks nothing"


def test_stream_identities_equal_batch(spark):
    batch = spark_rows(QUERIES["tracked_identities"](spark, SF_DIR))
    stream = spark_rows(QUERIES["stream_tracked_identities"](spark, SF_DIR))
    assert batch == stream and batch[1]


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
