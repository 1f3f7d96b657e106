"""Every registered query against its SQL, as the driver compares them."""

import duckdb
import pandas as pd
import pytest

from tributary.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    assert len(found)
    if name in registry.ORACLE:
        want = duck.execute(registry.ORACLE[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found.convert_dtypes()) == rows(want.convert_dtypes())


def test_every_query_but_the_engine_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"fuse_engine"}
