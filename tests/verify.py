"""Compares each query with its SQL on a data folder: python tests/verify.py [folder] [name...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    return str(v)


def oracle_rows(sql: str, folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{src}'")
    r = con.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def compare(spark, name: str, fn, sql: str, folder: str) -> str:
    df = fn(spark, folder)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    names, rows = oracle_rows(sql, folder)
    if sorted(names) != cols:
        return f"columns {cols} / {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted(tuple(cell(r[i]) for i in order) for r in rows)
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} rows / {len(want)}; only Spark {sorted(a)[:3]}; only SQL {sorted(b)[:3]}"
    return f"ok {len(got)}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from periodiq.session import get_spark

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("8")
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or qs:
        t = time.time()
        try:
            said = compare(spark, n, qs[n], sqls[n], folder) if n in sqls else f"rows {qs[n](spark, folder).count()}"
        except Exception as ex:  # noqa: BLE001
            said = f"ERROR {type(ex).__name__} {str(ex)[:600]}"
        print(f"{n}: {said} ({time.time() - t:.1f} s)", flush=True)
