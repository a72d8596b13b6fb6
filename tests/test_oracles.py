"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle_check import compare, connect

from marketlens.registry import oracle_queries, spark_queries

SF = os.environ.get("ORACLE_SF", "sf0.001")
SF_DIR = f"/root/testdata/{SF}"
QUERIES, ORACLES = spark_queries(), oracle_queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    if name not in ORACLES:
        assert list(got.columns)
        return
    duck.execute(ORACLES[name])
    assert compare(got, duck.fetchdf()).startswith("ok")
