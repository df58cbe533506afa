"""Every registered query of the library against its SQL on DuckDB."""

import duckdb
import pytest

from voxelrank import catalog, catalog_parts, catalog_sources

QUERIES, SQL = {**catalog.QUERIES, **catalog_parts.QUERIES, **catalog_sources.QUERIES}, {**catalog.SQL, **catalog_parts.SQL, **catalog_sources.SQL}
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(values):
    return sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    left = [tuple(r[c] for c in order) for r in got.collect()]
    right = [tuple(r[names.index(c)] for c in order) for r in want.fetchall()]
    key = lambda r: tuple((v is None, str(type(v)) if v is None else v) for v in r)
    left, right = sorted(left, key=key), sorted(right, key=key)
    assert len(left) == len(right)
    for a, b in zip(left, right):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 2e-5) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
