import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


def plain(v):
    """A value as the comparison with SQL sees it."""
    import decimal

    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compare a query's rows with those of its SQL on the smallest tables."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")

    def check(query, sql):
        df = query(spark, f"{DATA}/sf0.001")
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        ours = sorted(str([plain(r[c]) for c in order]) for r in df.collect())
        theirs = sorted(str([plain(r[names.index(c)]) for c in order]) for r in got.fetchall())
        assert ours == theirs

    return check
