import pytest
from oracle import connect, differences

from factloom.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, db, name):
    assert differences(spark, QUERIES[name], ORACLE_SQL[name], sf, db) == ""
