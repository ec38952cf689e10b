"""Run one registered query in Spark and its SQL in DuckDB, and compare."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "~null"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in data)


def compare(spark, sf, key, queries, oracles):
    t = time.time()
    df = queries[key](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if key not in oracles:
        return {"key": key, "ok": None, "rows": len(got), "sec": took, "cols": df.columns}
    con = duck(sf)
    t = time.time()
    cur = con.execute(oracles[key])
    cols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    want = rows(cols, cur.fetchall())
    dsec = time.time() - t
    ok = sorted(cols) == sorted(df.columns) and got == want
    out = {"key": key, "ok": ok, "rows": len(got), "want": len(want), "sec": took, "duck": dsec}
    if sorted(cols) != sorted(df.columns):
        out["cols"] = (sorted(df.columns), sorted(cols))
    elif not ok:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
        out["diff"] = (sorted(cols), diff)
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
             "boolean": "BOOLEAN", "smallint": "SMALLINT", "float": "FLOAT"}
    types = [(c, d, dtypes.get(c)) for c, d in df.dtypes if names.get(d) != dtypes.get(c)]
    if types:
        out["types"] = types
    return out


if __name__ == "__main__":
    import sys

    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e
    from tilewright.session import local_session

    sf = sys.argv[1]
    pick = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, os_ = e.queries(), e.oracle_sql()
    keys = [k for k in qs if not pick or any(k == p or (p.endswith("*") and k.startswith(p[:-1])) for p in pick)]
    bad = 0
    for k in keys:
        try:
            r = compare(spark, sf, k, qs, os_)
        except Exception as ex:  # report and go on
            r = {"key": k, "ok": False, "error": str(ex)[:1500]}
        flag = {True: "ok  ", False: "FAIL", None: "rows"}[r["ok"]]
        bad += r["ok"] is False
        extra = {a: b for a, b in r.items() if a in ("diff", "cols", "types", "error")}
        print(f"{flag} {k:28s} rows={r.get('rows')} spark={r.get('sec', 0):.2f}s duck={r.get('duck', 0):.2f}s {extra or ''}", flush=True)
    print(f"{len(keys)} queries, {bad} failing")
