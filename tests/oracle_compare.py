"""Compare registered Spark queries with their DuckDB SQL twins (used by tests and by hand).

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    try:
        import numpy as np
        if isinstance(v, np.generic):
            return _norm(v.item())
    except Exception:
        pass
    return v


def frame_rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    ddf = con.execute(sql).df()
    t2 = time.time()
    scols, srows = frame_rows(sdf)
    dcols, drows = frame_rows(ddf)
    ok = scols == dcols and srows == drows
    msg = f"{name}: spark {len(srows)} rows {t1 - t0:.1f}s, duck {len(drows)} rows {t2 - t1:.1f}s -> {'OK' if ok else 'MISMATCH'}"
    if not ok:
        if scols != dcols:
            msg += f"\n  cols spark={scols} duck={dcols}"
        else:
            ss, ds = set(srows), set(drows)
            msg += f"\n  only spark: {list(ss - ds)[:3]}\n  only duck: {list(ds - ss)[:3]}"
    return ok, msg


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from threadlens.session import get_session
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            print(f"{name}: no oracle (rows-only)")
            continue
        try:
            ok, msg = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as exc:  # report and continue
            ok, msg = False, f"{name}: ERROR {type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(msg, flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
