"""Every registered query against DuckDB on the same rows."""

import os

import duckdb
import pytest

from granary import catalog
from granary.queries.base import Tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    rows = catalog.queries()[name](spark, SF)
    got = rows.collect()
    if name not in catalog.oracle_sql():
        assert got
        return
    want = duck.execute(catalog.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(rows.columns)
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got) == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_domain_tables_are_the_same_in_both(spark, duck):
    from granary.queries.base import VIEWS

    t, made = Tables(spark, SF), []
    for name, sql in VIEWS.items():
        duck.execute(f"CREATE OR REPLACE TEMP VIEW {name} AS {sql}")
        made.append(name)
        df = getattr(t, name)
        want = duck.execute(f"SELECT {', '.join(df.columns)} FROM {name}").fetchall()
        assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in want), name
    for name in reversed(made):
        duck.execute(f"DROP VIEW {name}")
