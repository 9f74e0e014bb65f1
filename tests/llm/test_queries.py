import pytest

from lexloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf, same, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.count() > 0 and "doc_id" in df.columns
