"""Every catalogue query that has SQL, against DuckDB over the smallest tables."""

import duckdb
import pytest

from mrflow.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    rows = sorted((tuple(str(r[names.index(c)]) for c in cols) for r in want.fetchall()))
    assert sorted(tuple(str(r[c]) for c in cols) for r in got.collect()) == rows


def test_file_downsample_is_nested_and_whole(spark):
    rows = catalog.queries()["q24_file_downsample"](spark, SF).collect()
    assert len(rows) == len(TABLES)
    assert all(r["in_half"] or not r["in_quarter"] for r in rows)
