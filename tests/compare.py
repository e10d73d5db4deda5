"""Run registered queries against their SQL checks.

    python -m tests.compare [--sf DIR] [name prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from annalist.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value.is_integer() else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr), sorted(columns)


def duck(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def check(spark, con, name, build, sql, sf_dir, verbose=True):
    began = time.time()
    frame = build(spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    spark_time = time.time() - began
    if not sql:
        print(f"ROWS  {name}: {len(rows)} rows, {spark_time:.1f}s")
        return True
    began = time.time()
    result = con.execute(sql)
    expected_columns = [d[0] for d in result.description]
    expected = result.fetchall()
    sql_time = time.time() - began
    got, got_columns = rows_of(frame.columns, rows)
    want, want_columns = rows_of(expected_columns, expected)
    same = got == want and got_columns == want_columns
    print(f"{'ok   ' if same else 'FAIL '} {name}: {len(rows)}/{len(expected)} rows, {spark_time:.1f}s, sql {sql_time:.1f}s")
    if not same and verbose:
        if got_columns != want_columns:
            print("  columns", got_columns, want_columns)
        left, right = set(map(repr, got)), set(map(repr, want))
        for line in sorted(left - right)[:3]:
            print("  spark:", line[:500])
        for line in sorted(right - left)[:3]:
            print("  sql:  ", line[:500])
    return same


def main(argv):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0] == "--sf":
        sf_dir, argv = argv[1], argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = []
    for name, build in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            if not check(spark, con, name, build, checks.get(name), sf_dir):
                bad.append(name)
        except Exception as error:  # noqa: BLE001
            print(f"ERROR {name}: {type(error).__name__} {str(error)[:700]}")
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
