"""Every query that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from terravane.plans import registry

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return con


def plain(rows):
    one = lambda v: int(v) if isinstance(v, float) and v == int(v) else v
    return sorted((tuple(str(one(v)) for v in r) for r in rows))


@pytest.mark.parametrize("name", [n for n, (_, sql) in registry.REGISTRY.items() if sql])
def test_matches_sql(spark, duck, name):
    run, sql = registry.REGISTRY[name]
    got = run(spark, AT)
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    assert plain(got.select(cols).collect()) == plain(want)


@pytest.mark.parametrize("name", [n for n, (_, sql) in registry.REGISTRY.items() if not sql])
def test_runs(spark, name):
    assert registry.REGISTRY[name][0](spark, AT).count() > 0
