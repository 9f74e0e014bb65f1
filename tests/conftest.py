import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lexloom.session import build_session

    session = build_session(app="tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


@pytest.fixture(scope="session")
def same(duck):
    """Compare a DataFrame with a SQL statement: columns, and rows in any order with doubles to six digits."""
    def norm(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    def check(df, sql):
        cols = sorted(df.columns)
        got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
        res = duck.execute(sql)
        names = [d[0] for d in res.description]
        assert sorted(names) == cols
        want = sorted(repr([norm(r[names.index(c)]) for c in cols]) for r in res.fetchall())
        assert got == want

    return check
