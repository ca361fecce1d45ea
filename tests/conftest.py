import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_as_sql(spark, small):
    """Holds a query against its SQL on the smallest tables."""
    import duckdb
    import pandas as pd

    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")

    def normal(df):
        df = df[sorted(df.columns)].copy()
        for c in df.columns:
            if df[c].dtype.kind == "M" or df[c].map(type).astype(str).str.contains("date").any():
                df[c] = pd.to_datetime(df[c]).dt.strftime("%F")
            elif df[c].dtype.kind in "iuf":
                df[c] = df[c].astype(float).round(6)
        return df.astype(object).where(df.notna(), None).astype(str).sort_values(list(df.columns)).reset_index(drop=True)

    def check(query, sql):
        ours, theirs = normal(query(spark, small).toPandas()), normal(db.sql(sql).df())
        pd.testing.assert_frame_equal(ours, theirs)

    return check
