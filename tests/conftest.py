import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf_dir():
    where = "/root/testdata/sf0.001"
    if not os.path.isdir(where):
        pytest.skip("no test tables here")
    return where


@pytest.fixture(scope="session")
def duck(sf_dir):
    """DuckDB with the test tables as views."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="session")
def same_rows():
    """Compares a DataFrame with a DuckDB relation: column names, and rows in any order."""

    def compare(df, relation):
        names = sorted(df.columns)
        assert names == sorted(relation.columns)
        got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
        at = [relation.columns.index(c) for c in names]
        want = [tuple(plain(r[i]) for i in at) for r in relation.fetchall()]
        assert sorted(got, key=repr) == sorted(want, key=repr)

    return compare
