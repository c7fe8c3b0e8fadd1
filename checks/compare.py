"""Run registered queries next to their SQL on the same tables and compare the rows."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v: object) -> str:
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, pd.Timestamp):
            return v.strftime("%Y-%m-%d %H:%M:%S.%f")
        if hasattr(v, "strftime"):
            return pd.Timestamp(v).strftime("%Y-%m-%d %H:%M:%S.%f")
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return repr(round(float(v), 9))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    """'' when equal, else the first difference."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    a, b = canonical(spark_df), canonical(sql_df)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}" if bad else ""


def main(names: list[str], sf_dir: str) -> int:
    from checks.oracles import ORACLES
    from checks.queries import QUERIES

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con, failed = database(sf_dir), 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows {name:32s} {len(got):7d} {took:5.1f}s", flush=True)
                continue
            verdict = compare(got, con.sql(ORACLES[name]).df())
            print(f"{'DIFF' if verdict else 'ok  '} {name:32s} {len(got):7d} {took:5.1f}s sql {time.time() - start - took:4.1f}s {verdict[:700]}", flush=True)
            failed += bool(verdict)
        except Exception as error:  # noqa: BLE001 - report and go on
            print(f"FAIL {name} {str(error)[:700]}", flush=True)
            failed += 1
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[2:], sys.argv[1]))
