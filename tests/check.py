"""Run registered queries against their SQL oracle: ``python tests/check.py [name…] [--sf DIR]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from logweave.plans.registry import TABLES

DATA = "/root/testdata/sf0.01"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return None if v is None else str(v)


def normal(columns: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(table, key=lambda r: tuple((x is not None, x or "") for x in r))


def compare(spark, con, job, sql: str, sf: str) -> str:
    """Empty when equal, else what differs first."""
    df = job(spark, sf)
    mine = normal(df.columns, df.collect())
    cur = con.execute(sql)
    theirs = normal([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"{mine[0]}\n  spark  {a}\n  oracle {b}"
    return ""


def main() -> int:
    import __spark_entry__ as entry
    from logweave import session

    args = sys.argv[1:]
    sf = DATA
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    zone = {"spark.sql.session.timeZone": os.environ.get("CHECK_ZONE", "UTC")}
    spark = session.build(master="local[8]", shuffle_partitions=8, **{"spark.driver.memory": "12g"}, **zone)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    jobs, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or jobs:
        t0 = time.time()
        try:
            if name in oracles:
                diff = compare(spark, con, jobs[name], oracles[name], sf)
            else:
                diff = "" if jobs[name](spark, sf).count() >= 0 else "?"
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - t0:.1f}s {'' if name in oracles else '(rows only) '}{diff}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
