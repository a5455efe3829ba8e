"""Every registered query has its SQL, and equals it on the smallest tables."""

from __future__ import annotations

import os

import pytest

from registry.oracles import ORACLES
from registry.queries import QUERIES
from tests.compare import difference, duck

SF_DIR = "/root/testdata/sf0.001"

# The driver compares every query; ALL_ORACLES=1 does so here as well.
SOME = [
    "activation_asof",
    "decode_messages",
    "decode_tiplocs",
    "feed_fold_association",
    "feed_fold_stanox",
    "flatten_stops",
    "history_pairs",
    "route_counts_per_minute",
    "stanox_main",
    "utc_parts",
]
NAMES = sorted(QUERIES) if os.environ.get("ALL_ORACLES") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_no_registered_result_is_empty(con):
    """A query whose result is empty proves nothing; the SQL tells without running the query."""
    empty = [name for name, sql in ORACLES.items() if con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] == 0]
    assert empty == []
