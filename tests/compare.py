"""Compare registered queries with their SQL on the same parquet tables.

Usage: python tests/compare.py <sf_dir> [key ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def cell(value):
    """One comparable form for equal values of different types."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def check(spark, con, folder, key, fn, sql):
    """None when equal, else a short description of the difference."""
    df = fn(spark, folder)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[1] else "no rows"
    cursor = con.execute(sql)
    want = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if not want[1]:
        return "no rows"
    if got[1] == want[1]:
        return None
    a, b = set(got[1]), set(want[1])
    return (
        f"rows {len(got[1])} vs {len(want[1])}; spark only {sorted(a - b, key=repr)[:3]}; "
        f"sql only {sorted(b - a, key=repr)[:3]}"
    )


def main() -> int:
    import __spark_entry__ as entry
    from terrascore.session import build_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "compare", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g", spark__log__level="ERROR",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, failed = duck(folder), entry.oracle_sql(), 0
    for key, fn in entry.queries().items():
        if wanted and key not in wanted:
            continue
        start = time.time()
        try:
            problem = check(spark, con, folder, key, fn, oracle.get(key))
        except Exception as error:  # report and go on with the others
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        if problem:
            failed += 1
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {key} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
