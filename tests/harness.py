"""Local stand-in for the driver's correctness check: run a registered Spark query and its
DuckDB oracle on the same parquet tables and compare row count, column names and values
(order-insensitive, floats to 1e-6).

CLI: ``python tests/harness.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

from bandwise.sources.tables import TABLES  # noqa: E402


def duck_conn(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, str(v)) if isinstance(v, str) else (1, v) for v in row)


def compare(spark_df, duck_df, tol: float = 1e-6) -> tuple[bool, str]:
    s_cols = sorted(spark_df.columns)
    d_cols = sorted(duck_df.columns)
    if s_cols != d_cols:
        return False, f"columns differ: {s_cols} vs {d_cols}"
    sp = [tuple(_norm(r[c]) for c in s_cols) for r in spark_df.to_dict("records")]
    dk = [tuple(_norm(r[c]) for c in s_cols) for r in duck_df.to_dict("records")]
    if len(sp) != len(dk):
        return False, f"row count {len(sp)} vs {len(dk)}"
    sp.sort(key=_key)
    dk.sort(key=_key)
    for a, b in zip(sp, dk):
        for x, y, c in zip(a, b, s_cols):
            if x is None or y is None:
                if x is not y:
                    return False, f"null mismatch in {c}: {a} vs {b}"
            elif isinstance(x, float) or isinstance(y, float):
                if abs(float(x) - float(y)) > tol * max(1.0, abs(float(y))):
                    return False, f"value mismatch in {c}: {a} vs {b}"
            elif x != y:
                return False, f"value mismatch in {c}: {a} vs {b}"
    return True, f"{len(sp)} rows"


def run_one(spark, con, name: str, sf_dir: str):
    import __spark_entry__ as E

    t0 = time.time()
    sdf = E.queries()[name](spark, sf_dir).toPandas()
    t1 = time.time()
    sql = E.oracle_sql().get(name)
    if sql is None:
        return None, f"rows-only: {len(sdf)} rows", t1 - t0
    ddf = con.execute(sql).df()
    ok, msg = compare(sdf, ddf)
    return ok, msg, t1 - t0


def main(argv):
    from bandwise.session import get_session
    import __spark_entry__ as E

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or sorted(E.queries())
    spark = get_session("local[8]")
    con = duck_conn(sf_dir)
    bad = 0
    for n in names:
        try:
            ok, msg, dt = run_one(spark, con, n, sf_dir)
        except Exception as e:  # report and continue
            ok, msg, dt = False, f"ERROR {type(e).__name__}: {str(e)[:300]}", 0.0
        tag = "SKIP" if ok is None else ("OK  " if ok else "FAIL")
        bad += ok is False
        print(f"{tag} {n:28s} {dt:6.2f}s {msg}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
