"""Compare queries with their SQL on one scale factor: python tests/compare.py SF_DIR [NAME...]."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v) if hasattr(v, "isoformat") else v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'" if p.is_file() else f"create view {p.stem} as select * from '{p}/*.parquet'")
    return con


def differences(spark, con, name, sf_dir, queries, oracles) -> str:
    """'' if the query and its SQL agree on columns and rows."""
    df = queries[name](spark, sf_dir)
    got = df.collect()
    if name not in oracles:
        return ""
    want = con.sql(oracles[name])
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(df.columns)} against {sorted(want.columns)}"
    a, b = rows_of(df.columns, got), rows_of(want.columns, want.fetchall())
    if a == b:
        return ""
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    x, y = (a[i : i + 1] or [()])[0], (b[i : i + 1] or [()])[0]
    shown = [(c, repr(p)[:300], repr(q)[:300]) for c, p, q in zip(sorted(df.columns), x, y) if p != q]
    return f"{len(a)} rows against {len(b)}, first difference at {i}: {shown or (x, y)}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from sparkloom import session

    sf, names = sys.argv[1], sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark = session.build("local[2]", 4)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for n in names or [q for q in queries if not q.startswith("op") and q != "pipeline"]:
        began = time.time()
        try:
            d = differences(spark, con, n, sf, queries, oracles)
        except Exception as e:  # the other queries are still of interest
            d = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{'ok  ' if not d else 'DIFF'} {n} {time.time() - began:.1f}s{'' if n in oracles else ' (no SQL)'} {d}", flush=True)
