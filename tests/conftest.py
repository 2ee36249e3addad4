import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "3g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    from loomwork.sources.workers import shipped

    shipped(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def same_rows(duck):
    """Whether a DataFrame has the rows and columns of a SQL text."""

    def check(df, sql):
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        want = [dict(zip(names, r)) for r in cursor.fetchall()]
        columns = sorted(df.columns)
        assert columns == sorted(names)
        key = lambda r: repr([r[c] for c in columns])
        assert sorted(map(key, (r.asDict() for r in df.collect()))) == sorted(map(key, want))

    return check
