"""Compare registered queries with their SQL on DuckDB.

Usage: python tests/oracle_check.py [sf folder] [name or prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None else (
                [round(float(x), 6) if isinstance(x, float) else x for x in v] if isinstance(v, (list, np.ndarray)) else v)).map(repr)
    return df.sort_values(list(df.columns), kind="mergesort").reset_index(drop=True)


def kind(dtype) -> str:
    return {"i": "int", "u": "int", "f": "float", "b": "bool", "O": "object", "M": "time"}.get(dtype.kind, dtype.kind)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns differ: {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows differ: {len(spark_df)} vs {len(sql_df)}"
    a, b = canonical(spark_df), canonical(sql_df)
    for c in a.columns:
        if len(a) and kind(a[c].dtype) != kind(b[c].dtype):
            return f"type of {c}: {a[c].dtype} vs {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = int(np.flatnonzero(~same.to_numpy())[0])
            return f"{int((~same).sum())} values of {c} differ, first {a[c][i]!r} vs {b[c][i]!r}"
    return "ok"


def main() -> None:
    from evenkeel.plans.catalogue import ORACLES, QUERIES
    from evenkeel.session import session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not args[1:] or any(n == p or n.startswith(p.rstrip("*")) and p.endswith("*") for p in args[1:])]
    spark = session("oracle-check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for n in names:
        t = time.time()
        try:
            got = QUERIES[n](spark, folder).toPandas()
            took = time.time() - t
            note = f"rows only ({len(got)})" if n not in ORACLES else compare(got, con.execute(ORACLES[n]).df())
        except Exception as e:  # noqa: BLE001
            took, note = time.time() - t, f"ERROR {type(e).__name__}: {str(e)[:400]}"
            got = []
        if note != "ok":
            bad += not note.startswith("rows only")
        print(f"{n:34s} {took:6.2f}s rows={len(got):<7d} {note}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    sys.stdout.flush()


if __name__ == "__main__":
    main()
