"""Compare registered Spark queries with their DuckDB oracle SQL.

Usage: ``python -m querylens.checks.oracle [sf_dir] [name ...]``.  Prints one
line per query (rows, schema, values) and a summary; the comparison sorts
columns by name and rows by value, as the driver does.
"""

from __future__ import annotations

import math
import sys
import time

from ..sources.tables import TABLES, table_path


def duckdb_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, bool):
        return int(v)
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__), x if x is not None else 0) for x in row)


def normalise(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: repr(r))
    return [cols[i] for i in order], out


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = list(sdf.columns)
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    sc, sr = normalise(scols, srows)
    dc, dr = normalise(dcols, drows)
    info = {"name": name, "rows": (len(sr), len(dr)), "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    info["schema_ok"] = sc == dc
    info["rows_ok"] = len(sr) == len(dr)
    info["values_ok"] = info["schema_ok"] and sr == dr
    if not info["values_ok"]:
        info["cols"] = (sc, dc)
        diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
        info["first_diff"] = diff
    return info


def main(argv=None):
    argv = list(sys.argv[1:] if argv is None else argv)
    sf_dir = argv.pop(0) if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    sys.path.insert(0, ".")
    from querylens import registry
    from querylens.session import get_spark
    registry.load_all()
    spark = get_spark("local[8]", 8, extra={"spark.ui.showConsoleProgress": "false"})
    con = duckdb_connect(sf_dir)
    rows_only = "--rows-only" in argv
    argv = [a for a in argv if a != "--rows-only"]
    if rows_only:
        names = argv or sorted(set(registry.QUERIES) - set(registry.ORACLES))
    else:
        names = argv or sorted(registry.ORACLES)
    bad = 0
    for n in names:
        try:
            if n not in registry.ORACLES:
                t0 = time.time()
                df = registry.QUERIES[n](spark, sf_dir)
                cnt = df.count()
                info = {"name": n, "rows": cnt, "spark_s": round(time.time() - t0, 2), "values_ok": True,
                        "schema": df.columns[:12]}
            else:
                info = compare(spark, con, n, registry.QUERIES[n], registry.ORACLES[n], sf_dir)
        except Exception as e:  # report and continue
            info = {"name": n, "error": repr(e)[:600]}
        ok = info.get("values_ok")
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(info), flush=True)
    print(f"SUMMARY {len(names) - bad}/{len(names)} match", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
