import glob
import os

import pandas as pd

DATA = "/root/testdata/sf0.001"


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if value is None or pd.isna(value):
        return "null"
    return f"{value:.6f}" if isinstance(value, float) else str(int(value) if isinstance(value, bool) else value)


def rows(frame, columns):
    return sorted(tuple(plain(v) if not isinstance(v, int) else plain(float(v)) for v in row) for row in frame[columns].values.tolist())


def database(folder=DATA):
    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def same(spark_frame, sql_frame):
    columns = sorted(sql_frame.columns)
    assert sorted(spark_frame.columns) == columns
    assert rows(spark_frame, columns) == rows(sql_frame, columns)
