"""Run registered queries beside their SQL and report differences: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(value)
    if hasattr(value, "is_finite"):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def fingerprint(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, sf: str, name: str, fn, sql: str | None, con) -> tuple[str, float]:
    start = time.time()
    df = fn(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if sql is None:
        return f"rows={len(rows)}", spent
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} / {sorted(names)}", spent
    mine, theirs = fingerprint(df.columns, rows), fingerprint(names, expected)
    if mine == theirs:
        return "ok", spent
    diff = next(((a, b) for a, b in zip(mine, theirs) if a != b), (len(mine), len(theirs)))
    return f"DIFF {len(mine)}/{len(theirs)} rows {diff}", spent


if __name__ == "__main__":
    from strataframe import session
    from workload import QUERIES, SQL

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = [q for q in QUERIES if not sys.argv[2:] or q in sys.argv[2:] or QUERIES[q].__module__.split(".")[-1] in sys.argv[2:]]
    spark = session.build("local[8]", 8, **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name in wanted:
        try:
            verdict, spent = compare(spark, sf, name, QUERIES[name], SQL.get(name), con)
        except Exception as error:  # noqa: BLE001
            verdict, spent = f"ERROR {type(error).__name__} {str(error)[:1500]}", 0.0
        bad += not (verdict == "ok" or verdict.startswith("rows="))
        print(f"{name:36s} {spent:6.2f}s {verdict[:2000]}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
