"""Compares queries with their SQL: python tests/compare.py SF NAME... (all, if none is named)."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd


def norm(v):
    if v is None or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    return str(v)


def rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(norm(x) for x in r) for r in pdf[cols].astype(object).where(pdf[cols].notna(), None).itertuples(index=False))


def connect(root: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(root)):
        if f.endswith(".parquet"):
            p = f"{root}/{f}" + ("/*.parquet" if os.path.isdir(f"{root}/{f}") else "")
            con.execute(f"create view {f[:-8]} as select * from '{p}'")
    return con


def compare(spark, con, root, name, query, sql):
    got = rows(query(spark, root).toPandas())
    if sql is None:
        return "rows only", len(got[1]), None, []
    want = rows(con.execute(sql).df())
    if got == want:
        return "ok", len(got[1]), len(want[1]), []
    g, w = set(got[1]), set(want[1])
    return "DIFFERS", len(got[1]), len(want[1]), [got[0], want[0], sorted(g - w)[:4], sorted(w - g)[:4]]


if __name__ == "__main__":
    import __spark_entry__ as e
    from loomspark.session import get_session

    root = f"/root/testdata/{sys.argv[1]}"
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls = connect(root), e.queries(), e.oracle_sql()
    names = [k for k in qs if not sys.argv[2:] or any(k == a or a.endswith("*") and k.startswith(a[:-1]) for a in sys.argv[2:])]
    for k in names:
        t = time.time()
        try:
            print(k, *compare(spark, con, root, k, qs[k], sqls.get(k)), f"{time.time() - t:.1f}s", flush=True)
        except Exception as x:
            print(k, "ERROR", str(x)[:1500], flush=True)
