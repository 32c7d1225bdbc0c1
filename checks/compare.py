"""Run registered queries against their SQL and report differences: python -m checks.compare [sf] [names...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import datetime
from decimal import Decimal

import duckdb

from checks.registry import QUERIES, run
from checks.sql import ORACLE

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else round(number, 6)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = run(spark, name, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in ORACLE:
        return True, f"{len(got_rows)} rows, no SQL, {took:.1f}s"
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    want_rows = found.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    got, want = rows_of(df.columns, got_rows), rows_of(names, want_rows)
    if got == want:
        return True, f"{len(got_rows)} rows, {took:.1f}s"
    more, less = got - want, want - got
    return False, (f"{len(got_rows)} vs {len(want_rows)} rows; only Spark {sum(more.values())}: "
                   f"{list(more)[:2]}; only SQL {sum(less.values())}: {list(less)[:2]}")


def main() -> int:
    from eventloom.session import build_session

    args = sys.argv[1:]
    sf_dir = f"/root/testdata/sf{args[0] if args else '0.01'}"
    names = args[1:] or list(QUERIES)
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as error:  # report every query, then fail at the end
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}".replace("\n", " ")
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + note, flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
