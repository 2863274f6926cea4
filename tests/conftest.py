import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
            .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def oracle():
    """compare(spark, queries, sql, names): runs each query and its SQL over the smallest tables."""
    import duckdb
    import numpy as np
    import pandas as pd

    folder = os.environ.get("QUILLSPAN_TEST_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")

    def cell(v):
        if v is None or (not isinstance(v, (list, np.ndarray, dict)) and pd.isna(v)):
            return "NULL"
        return format(float(v), ".9g") if isinstance(v, (float, np.floating)) else str(list(v)) if isinstance(v, np.ndarray) else str(v)

    def rows(df):
        df = df[sorted(df.columns)]
        return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))

    def compare(spark, query, sql):
        mine = query(spark, folder).toPandas()
        if sql is None:
            return mine
        theirs = con.execute(sql).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert rows(mine) == rows(theirs)
        return mine

    return compare
