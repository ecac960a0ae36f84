import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))  # for Python workers


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.local.dir", folder).config("spark.checkpoint.dir", f"{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the smallest tables as views, and a way to compare rows."""
    import duckdb

    con = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def same_rows(want, got):
    plain = lambda rows: sorted(repr(tuple(float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r)) for r in rows)
    assert plain(want) == plain(got)
