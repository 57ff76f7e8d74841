"""Compare registered queries with their SQL twins: python tests/oracle.py SF_DIR [NAME...]."""

from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [None if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x) else (x if not isinstance(x, float) else x + 0.0) for x in df[c].astype(object)]
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None."""
    a, b = normal(spark_df.toPandas()), normal(con.execute(sql).df())
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} and {list(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = pd.Series(False, index=a.index)
    for c in a.columns:
        for k in a.index[a[c] != b[c]]:
            try:
                bad[k] |= float(a[c][k]) != float(b[c][k])
            except ValueError:
                bad[k] = True
    return f"{bad.sum()} of {len(a)} rows, as\n{a[bad].head(3).to_string()}\n{b[bad].head(3).to_string()}" if bad.any() else None


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(sys.argv[1]), e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or sql:
        try:
            found = difference(queries[name](spark, sys.argv[1]), con, sql[name])
        except Exception as x:  # noqa: BLE001
            found = f"{type(x).__name__}: {str(x)[:600]}"
        print(name, "ok" if found is None else f"DIFFERS {found}", flush=True)


if __name__ == "__main__":
    main()
