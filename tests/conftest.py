import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", own)
        .config("spark.sql.warehouse.dir", f"{own}/warehouse")
        .config("spark.checkpoint.dir", f"{own}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a query and its SQL give the same rows."""

    def plain(v):
        return float(f"{v:.9g}") if isinstance(v, float) else v

    def check(query, sql):
        df, found = query(spark, SF), duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names)
        ours = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
        at = [names.index(c) for c in sorted(names)]
        theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
        assert ours == theirs

    return check
