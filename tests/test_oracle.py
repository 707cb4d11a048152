"""Every registered query runs on the smallest tables; those with SQL must equal it."""

import pytest

from gleanery.plans.catalogue import load

from .oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
# timed by bench.py and checked in test_streams.py; they start a stream each
SLOW = {n for n in QUERIES if n.startswith("stream_")}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    verdict, _rows = compare(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert verdict in ("ok", "rows")


#: Queries without SQL: hashes or contents DuckDB cannot give, a per-window edit distance, and a quota state per
#: request. Each has a test of its own in test_operators.py, test_kernels.py or test_streams.py.
WITHOUT_SQL = {"file_inventory", "block_keys", "anchor_fuzzy", "stream_admission"}


def test_every_query_has_an_oracle_or_is_listed():
    assert set(ORACLES) | WITHOUT_SQL == set(QUERIES) and not set(ORACLES) & WITHOUT_SQL
