"""Runs registered queries and their SQL side by side: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketlens.fixtures import BASE_TABLES  # noqa: E402
from marketlens.registry import oracle_queries, spark_queries  # noqa: E402
from marketlens.session import build_session  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        cells = []
        for v in row:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                cells.append("<null>")
            elif isinstance(v, bool):
                cells.append(str(v))
            elif isinstance(v, (pd.Timestamp,)):
                cells.append(str(v))
            elif hasattr(v, "item"):
                cells.append(repr(v.item()))
            else:
                cells.append(repr(v) if not isinstance(v, str) else v)
        rows.append(tuple(cells))
    return sorted(rows)


def typed(frame: pd.DataFrame) -> pd.DataFrame:
    for column in frame.columns:
        kind = frame[column].dtype
        if pd.api.types.is_float_dtype(kind) or pd.api.types.is_integer_dtype(kind):
            frame[column] = frame[column].astype("float64")
    return frame


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} vs {len(sql_frame)}"
    kinds = []
    for c in spark_frame.columns:
        a, b = spark_frame[c].dtype.kind, sql_frame[c].dtype.kind
        if a != b and len(spark_frame) and {a, b} != {"O", "b"} and not spark_frame[c].isna().any():
            kinds.append(f"{c}:{spark_frame[c].dtype}/{sql_frame[c].dtype}")
    left, right = canonical(typed(spark_frame)), canonical(typed(sql_frame))
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first: {sorted(spark_frame.columns)} {bad[0]}"
    return "type mismatch " + " ".join(kinds) if kinds else "ok"


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session("oracle-check", 8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    runs, oracles = spark_queries(), oracle_queries()
    names = [n for n in runs if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    failed = 0
    for name in names:
        started = time.time()
        try:
            got = runs[name](spark, sf_dir).toPandas()
            took = time.time() - started
            if name in oracles:
                started = time.time()
                con.execute(oracles[name])
                want = con.fetchdf()
                verdict = compare(got, want)
                verdict += f" rows={len(got)} spark={took:.1f}s sql={time.time() - started:.1f}s"
            else:
                verdict = f"ok (rows only) rows={len(got)} spark={took:.1f}s"
        except Exception as error:  # noqa: BLE001
            verdict = f"ERROR {type(error).__name__}: {str(error)[:400]}"
        if not verdict.startswith("ok"):
            failed += 1
        print(f"{name:28s} {verdict}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
