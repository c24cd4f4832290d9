"""Runs a query's SQL in DuckDB and compares rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted((tuple(str(float(x)) if isinstance(x, float) or hasattr(x, "as_integer_ratio") and not isinstance(x, bool) else str(x) for x in row) for row in df.itertuples(index=False)))


def assert_same(spark_df, sql: str, con) -> None:
    got, want = normal(spark_df.toPandas()), normal(con.execute(sql).df())
    assert len(got) == len(want)
    assert got == want
