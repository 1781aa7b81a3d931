"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from leafmill import catalog, oracles

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return f"{float(x):.6f}"
        return str(x)

    return sorted([tuple(cell(r[i]) for i in order) for r in rows])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracles.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, DATA)
    rel = duck.execute(oracles.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(ours.columns) == sorted(names)
    assert plain([tuple(r) for r in ours.collect()], ours.columns) == plain(rel.fetchall(), names)
