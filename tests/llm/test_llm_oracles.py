import pytest
from oracle import connect, differences

import __spark_entry__ as entry
from factloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    assert differences(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], sf, connect(sf)) == ""


def test_all_are_registered():
    queries = entry.queries()
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(registry.QUERIES) | {"pipeline"} <= set(queries) and set(entry.oracle_sql()) <= set(queries)
