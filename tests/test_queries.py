"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from medloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert name in catalog.SQL, "each reference query has its SQL"
    c = sql.execute(catalog.SQL[name])
    assert got == canonical([d[0] for d in c.description], c.fetchall())
