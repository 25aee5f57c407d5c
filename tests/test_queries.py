"""Every registered query of the core library against its SQL on the smallest tables."""

import duckdb
import pytest

from quillspark.plans import queries as core

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_like_sql(spark, duck, name):
    got = core.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = duck.execute(core.ORACLES[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    want = sorted((tuple(rounded(dict(zip(names, r))[c]) for c in columns) for r in rows.fetchall()), key=repr)
    assert sorted((tuple(rounded(r[c]) for c in columns) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
