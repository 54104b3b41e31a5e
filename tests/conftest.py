import math
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    """Values made comparable: floats to 9 digits, nested values as tuples."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_tuple"):
        return plain(float(v))
    return v


@pytest.fixture(scope="session")
def same(spark, duck):
    """Whether a query gives the rows of its SQL twin, in any order."""

    def check(f, sql):
        df = f(spark, DATA)
        names = sorted(df.columns)
        mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
        cursor = duck.execute(sql)
        there = [x[0] for x in cursor.description]
        assert sorted(there) == names
        theirs = sorted((tuple(plain(r[there.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
        assert mine == theirs

    return check
