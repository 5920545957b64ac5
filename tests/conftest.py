import os
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from pyspark.sql import SparkSession  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.checkpoint.dir", f"{scratch}/checkpoints")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{SF}/{name}')")
    return con


def plain(value):
    """A cell as text, the same for both engines."""
    import numpy as np

    if value is None or value != value:
        return "null"
    if isinstance(value, (float, np.floating)):
        return repr(round(float(value), 9))
    return str(value)


def same_rows(spark_df, duck_df) -> bool:
    columns = sorted(spark_df.columns)
    if columns != sorted(duck_df.columns):
        return False
    left = sorted(tuple(plain(row[c]) for c in columns) for row in spark_df.collect())
    index = [list(duck_df.columns).index(c) for c in columns]
    right = sorted(tuple(plain(row[i]) for i in index) for row in duck_df.fetchall())
    return left == right
