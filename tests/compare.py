"""Compare a Spark result with DuckDB's, whatever the order."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, folder: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.execute(sql).df()


def rows(df: pd.DataFrame) -> list:
    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, np.bool_):
            return bool(v)
        if isinstance(v, (np.integer, np.floating, float)):
            return int(v) if float(v).is_integer() else round(float(v), 9)
        return v

    return sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def same(spark_df, sql: str, folder: str) -> None:
    ours, theirs = spark_df.toPandas(), oracle(sql, folder)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
