import pytest
from oracle import connect, compare

import __spark_entry__ as contract
import oracle_queries
from tables import TESTDATA

QUERIES = contract.report_queries()
ORACLE = oracle_queries.oracle_sql()


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def sf(request):
    path = TESTDATA / request.param
    return str(path), connect(path)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_parity(spark, sf, name):
    sf_dir, con = sf
    compare(QUERIES[name](spark, sf_dir), con, ORACLE[name])


def test_entry(spark):
    assert contract.entry(spark).columns == ["mes_ano", "gmv"]
