"""Run registered queries against their SQL at a scale and compare whole results by value."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return (0, "")
        if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
            return (1, str(bool(v)))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return (2, f"{float(v):.9g}")
        return (3, str(v))

    columns = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} against {sorted(sql_frame.columns)}"
    left, right = canonical(spark_frame), canonical(sql_frame)
    if left == right:
        return None
    a, b = set(left), set(right)
    return f"rows {len(left)} against {len(right)}; only Spark {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}"


def main(sf: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from hunkwise.session import local_session

    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        try:
            start = time.time()
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"NOSQL {name} rows={len(got)} {took:.1f}s", flush=True)
                continue
            start = time.time()
            diff = differences(got, con.execute(oracles[name]).df())
            sql_took = time.time() - start
            bad += diff is not None
            print(f"{'ok   ' if diff is None else 'DIFF '} {name} rows={len(got)} spark={took:.1f}s sql={sql_took:.1f}s {diff or ''}", flush=True)
        except Exception as exc:  # report and go on
            bad += 1
            print(f"ERROR {name}: {type(exc).__name__} {str(exc)[:900]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
