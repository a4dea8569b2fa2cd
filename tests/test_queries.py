"""Every query with SQL gives the same rows in DuckDB; those without are covered by tests of their operators."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from skerry import queries as core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    by = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[k] for k in by) for r in rows), key=repr)


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_and_sql_agree(spark, db, name):
    got = core.QUERIES[name](spark, SF)
    rel = db.execute(core.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    expected = plain(rel.fetchall(), names)
    assert sorted(got.columns) == sorted(names)
    found = plain([tuple(r) for r in got.collect()], got.columns)
    assert len(found) == len(expected)
    assert all(len(x) == len(y) and all(map(same, x, y)) for x, y in zip(found, expected, strict=True))


def test_all_have_sql_and_entry_runs(spark):
    assert set(core.QUERIES) == set(core.ORACLE_SQL)
    assert set(core.QUERIES) <= set(driver.queries())
    assert set(driver.entry(spark).columns) == {"doc_id", "score"}
