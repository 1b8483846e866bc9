"""Every query of the package against DuckDB on the smallest tables."""

import duckdb
import pytest

from maskwright.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(tuple(repr(tidy(r[i])) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = rows(df.columns, df.collect())
    if name in ORACLE:
        r = duck.execute(ORACLE[name])
        assert found == rows([d[0] for d in r.description], r.fetchall())
    assert sorted(df.columns) == sorted(set(df.columns))


def test_status_distribution_counts_every_task(spark, duck):
    found = {r["pos"]: r["n"] for r in QUERIES["stats_status_dist"](spark, SF).collect()}
    assert found == dict(duck.execute("SELECT p, count(event_id) FROM range(6) s(p) LEFT JOIN events ON event_id % 6 = p GROUP BY p").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
