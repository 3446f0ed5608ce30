"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from veilgrain.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    return repr(round(float(v), 5) + 0.0) if isinstance(v, float) or type(v).__name__ == "Decimal" else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(tuple(map(plain, r)) for r in duck.sql(f"SELECT {quoted} FROM ({catalog.oracle_sql()[name]})").fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    catalog.queries()[name](spark, DATA).count()
