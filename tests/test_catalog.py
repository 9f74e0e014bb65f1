"""Every registered query against its SQL twin."""

import pytest

from lexloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, sf, same, name):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_does_not_need_the_corpus_operators():
    import pathlib
    import re

    top = pathlib.Path(catalog.__file__).parents[1]
    for p in top.rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert not re.search(r"lexloom\.llm|from lexloom import llm", p.read_text()), p
