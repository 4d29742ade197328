"""Run every registered query in Spark and its oracle SQL in DuckDB, and compare.

Usage: python tools/oracle_check.py [--sf-dir DIR] [name ...]

Mirrors the driver's gate: same column names, same row count, same multiset of rows. Floats are
compared exactly and, separately, to 1e-9 relative so a last-bit difference is visible as such.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _norm(v):
    import numpy as np
    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT:
        return (0, "")
    if isinstance(v, (bool, np.bool_)):
        return (5, str(bool(v)))
    if isinstance(v, (int, float, np.integer, np.floating)):
        f = float(v)
        return (1, "nan") if math.isnan(f) else (2, f)
    if isinstance(v, (list, tuple, np.ndarray)):
        return (3, repr([_norm(x) for x in list(v)]))
    return (4, str(v))


def _rows(tbl):
    cols = sorted(tbl.column_names)
    data = [tbl.column(c).to_pylist() for c in cols]
    out = [tuple(_norm(x) for x in rec) for rec in zip(*data)] if data else []
    out.sort(key=lambda r: tuple((a, str(b)) for a, b in r))
    return cols, out


def _close(a, b):
    if a == b:
        return True
    if a[0] == 2 and b[0] == 2:
        x, y = a[1], b[1]
        return abs(x - y) <= 1e-9 * max(1.0, abs(x), abs(y))
    return False


def compare(spark_pdf, duck_pdf):
    sc, sr = _rows(spark_pdf)
    dc, dr = _rows(duck_pdf)
    if sc != dc:
        return "COLUMNS", f"spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return "ROWCOUNT", f"spark={len(sr)} duck={len(dr)}"
    if sr == dr:
        return "EXACT", ""
    for a, b in zip(sr, dr):
        if not all(_close(x, y) for x, y in zip(a, b)):
            return "VALUES", f"first diff spark={a} duck={b}"
    return "CLOSE", "floats differ in last bits"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()

    from keelson.plans.catalog import oracle_sql, queries
    from keelson.session import local_session

    spark = local_session(8, 8)
    qs, sqls = queries(), oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf_dir}/{t}.parquet')")
    names = args.names or sorted(qs)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = qs[name](spark, args.sf_dir)
            spdf = sdf.toArrow()
            ts = time.time() - t0
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK-ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        if name not in sqls:
            print(f"{name:32s} ROWS-ONLY rows={spdf.num_rows} spark={ts:.2f}s")
            continue
        try:
            dpdf = con.sql(sqls[name]).to_arrow_table()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} DUCK-ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        status, detail = compare(spdf, dpdf)
        if status not in ("EXACT", "CLOSE"):
            bad += 1
        dtypes = {f.name: str(f.type) for f in dpdf.schema}
        types = " ".join(f"{f.name}:{f.type}/{dtypes.get(f.name)}" for f in spdf.schema)
        print(f"{name:32s} {status:8s} rows={spdf.num_rows} spark={ts:.2f}s {detail[:600]}")
        if os.environ.get("CHECK_TYPES"):
            print("    types", types)
    from keelson.session import clear_scratch

    clear_scratch(spark)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
