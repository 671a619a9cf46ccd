"""Run registered queries next to their DuckDB twins and report differences.

    python -m verification.compare [--sf DIR] [KEY ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(path: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet')")
    return con


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item") and not isinstance(value, pd.Timestamp):
        value = value.item()
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return str([_cell(v) for v in value])
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value) + 0.0)
    if hasattr(value, "isoformat"):
        text = pd.Timestamp(value).isoformat()
        return text[:-9] if text.endswith("T00:00:00") else text
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    data = [tuple(_cell(v) for v in row) for row in frame.astype(object).itertuples(index=False, name=None)]
    return sorted(data, key=lambda r: tuple("" if v is None else str(v) for v in r))


def compare(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None when both frames hold the same rows, otherwise a short description of the difference."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    a, b = rows(left), rows(right)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} rows differ, first {wrong[0]}"
    kinds = {c: (left[c].dtype.kind, right[c].dtype.kind) for c in left.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and set(k) != {'O', 'M'} and len(left) and not left[c].isna().any()}
    return None if not odd else f"types {odd}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--slow", type=float, default=3.0)
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args()

    from lakegauge.session import local_session
    from verification.registry import load_all

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    checks = load_all()
    keys = args.keys or list(checks)
    keys = [k for k in checks if any(k == a or (a.endswith("*") and k.startswith(a[:-1])) for a in keys)]
    for key in keys:
        item = checks[key]
        began = time.time()
        try:
            left = item.run(spark, args.sf).toPandas()
            took = time.time() - began
            sql = item.oracle()
            if sql is None:
                print(f"rows  {key}: {len(left)} ({took:.1f}s)", flush=True)
                continue
            problem = compare(left, con.execute(sql).df())
        except Exception as error:  # report and go on
            problem, took, left = f"{type(error).__name__}: {str(error)[:600]}", time.time() - began, []
        if problem:
            bad += 1
            print(f"FAIL  {key}: {problem}", flush=True)
        elif len(left) == 0:
            print(f"EMPTY {key}", flush=True)
        elif took > args.slow:
            print(f"slow  {key}: {took:.1f}s", flush=True)
    print(f"{len(keys)} queries, {bad} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
