"""Every query with oracle SQL, compared row by row on the smallest tables; the rest must give rows."""

import pytest

import __spark_entry__ as entry
from tripwise.checks.compare import compare, oracle_connection
from tripwise.checks.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("key", list(ORACLES))
def test_query_equals_oracle(spark, db, key):
    assert compare(spark, db, QUERIES[key], ORACLES[key], FOLDER) == []


def test_keys_cover_the_inventory():
    groups = {"S": 10, "P": 37, "J": 17, "A": 45, "W": 18, "L": 5, "U": 2, "M": 12}
    want = {f"{g}{i}" for g, n in groups.items() for i in range(1, n + 1)}
    named = {k.split("_")[0] for k in QUERIES}
    # a further query on the same operator has a b behind its number
    assert want <= named and {n.removesuffix("b") for n in named} == want
    assert set(QUERIES) == set(ORACLES)


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_entry_offers_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
