import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def duck(sf_dir: str):
    """DuckDB with the tables of sf_dir as views."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def same_rows(df, con, sql: str) -> None:
    """The frame and the SQL have the same columns and rows, in any order."""
    columns = sorted(df.columns)
    got = sorted(tuple(map(repr_, r)) for r in df.select(*columns).collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted(tuple(repr_(row[i]) for i in places) for row in found.fetchall())
    assert got == want


def repr_(value):
    return repr(value) if isinstance(value, float) else str(value)
