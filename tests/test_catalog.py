import duckdb
import pytest
from driftline import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("NULL" if x is None or x != x else str(int(x)) if isinstance(x, float) and x == int(x) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, DIR).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_stream_equals_batch(spark):
    a, b = (catalog.QUERIES[n](spark, DIR).toPandas().drop(columns="action", errors="ignore") for n in ("doc_latest_upsert", "stream_documents"))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root).returncode == 0
