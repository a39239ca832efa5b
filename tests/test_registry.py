import duckdb
import pytest

from gridloom.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(rows, columns):
    def one(v):
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, float) and v == int(v):
            return int(v)
        return v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(one(r[i]) for i in order)) for r in rows))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert got == plain(want.fetchall(), want.columns)
