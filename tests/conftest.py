import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(df, con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    cols = sorted(df.columns)
    assert sorted(names) == cols
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    assert got == sorted((tuple(dict(zip(names, r, strict=True))[c] for c in cols) for r in want), key=key)
    return len(got)
