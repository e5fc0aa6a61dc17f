"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Mirrors the driver's gate: row count, column names and types, and an
order-insensitive hash of the values (columns sorted by name, doubles rounded).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "boolean": "BOOLEAN"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, names=None, plans=None):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
            if plans is not None:
                plans[name] = df._jdf.queryExecution().executedPlan().toString()
        except Exception as exc:  # noqa: BLE001
            out[name] = dict(error=str(exc).splitlines()[0][:400], hash=False)
            continue
        t1 = time.time()
        if name not in sqls:
            out[name] = dict(rows=len(s_rows), oracle="rows-only", sec=round(t1 - t0, 2))
            continue
        cur = con.execute(sqls[name])
        d_cols = [c[0] for c in cur.description]
        d_types = {c[0]: str(c[1]) for c in cur.description}
        d_rows = cur.fetchall()
        s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
        ok_cols = sorted(s_cols) == sorted(d_cols) and s_types == d_types
        ok_n = len(s_rows) == len(d_rows)
        ok_h = ok_cols and digest(s_cols, s_rows) == digest(d_cols, d_rows)
        out[name] = dict(rows=len(s_rows), oracle_rows=len(d_rows), cols=ok_cols, count=ok_n,
                         hash=ok_h, sec=round(t1 - t0, 2))
        if not ok_h:
            out[name]["spark_types"] = s_types
            out[name]["duck_types"] = d_types
    return out


if __name__ == "__main__":
    from factsift.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, names)
    bad = 0
    for k, v in res.items():
        flag = "OK " if v.get("hash", v.get("oracle") == "rows-only") else "BAD"
        bad += flag == "BAD"
        print(flag, k, v)
    print(f"{len(res) - bad}/{len(res)} ok")
