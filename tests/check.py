"""Run registered queries on Spark and their check SQL on DuckDB and compare.

``python tests/check.py [--sf DIR] [--stored] [name ...]`` compares the named queries (all by default) exactly: column
names, column kinds and values. With ``--stored`` the queries read directory tables that are stored first.
"""

from __future__ import annotations

import collections
import datetime
import decimal
import math
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "float"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return type(value).__name__
    return type(value).__name__


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return f"{kind(value)}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, run, sql) -> str | None:
    """None when equal, else a short description."""
    df = run(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if not want:
        return "check SQL gives no rows"
    if a != b:
        return f"{len(got)} vs {len(want)} rows; spark only {list((a - b).items())[:2]}; sql only {list((b - a).items())[:2]}"
    return None


def connect(sf_dir):
    import duckdb

    from placeledger.plans.views import BASE_TABLES

    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main(argv):
    from placeledger.plans.registry import all_checks, all_queries, use_tables
    from placeledger.plans.views import store_tables
    from placeledger.session import build_session, checkpoint_dir

    sf = "/root/testdata/sf0.001"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    stored = "--stored" in argv
    argv = [a for a in argv if a != "--stored"]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    if stored:
        path = f"{checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4()}"
        store_tables(spark, sf, path)
        use_tables(sf, path)
    qs, cs = all_queries(), all_checks()
    bad = 0
    for name in argv or qs:
        started = time.time()
        try:
            problem = compare(spark, con, sf, qs[name], cs.get(name))
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        label = "ok" if problem is None else "BAD"
        if problem or argv:
            print(f"{label} {name} {time.time() - started:.2f}s {'' if name in cs else '(rows only)'} {problem or ''}")
    print(f"{len(argv or qs)} queries, {bad} bad, {len(cs)} with check SQL")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
