import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def compare():
    """Run a query in Spark and its SQL in DuckDB over the smallest given tables and compare all rows."""
    import glob

    import duckdb

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the given tables aren't here")

    def run(session, query, sql):
        con = duckdb.connect()
        for path in glob.glob(f"{folder}/*.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        got, want = query(session, folder).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        names = sorted(got.columns)
        got, want = (x[names].sort_values(names).reset_index(drop=True).astype(object) for x in (got, want))
        assert len(got) == len(want)
        assert got.where(got.notna(), None).equals(want.where(want.notna(), None)) or (got.fillna(-1) == want.fillna(-1)).all().all()

    return run
