"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows.

    python tests/compare.py [--sf 0.01] [name ...]
"""

import argparse
import collections
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0  # -0.0 equals 0.0
    return value


def row_bag(columns, rows):
    """Rows as a multiset, columns sorted by name, numbers kept apart by type."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(
        tuple((type(row[i]).__name__, _cell(row[i])) for i in order) for row in rows
    )


def differences(spark, con, sf_dir, query, sql):
    """(message or None, row count, Spark seconds)."""
    started = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return None, len(rows), took
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(rows), took
    mine, theirs = row_bag(df.columns, rows), row_bag(columns, expected)
    if mine != theirs:
        extra, missing = list((mine - theirs).items()), list((theirs - mine).items())
        return (
            f"rows {len(rows)} vs {len(expected)}; {len(extra)} extra, {len(missing)} missing\n"
            f"    extra   {extra[:2]}\n    missing {missing[:2]}",
            len(rows),
            took,
        )
    return None, len(rows), took


def main():
    from __spark_entry__ import oracle_sql, queries

    from tests.conftest import make_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    sf_dir = f"/root/testdata/sf{options.sf}"
    spark, con = make_session("local[8]"), connect(sf_dir)
    sql = oracle_sql()
    failed = 0
    for name, query in queries().items():
        if options.names and name not in options.names:
            continue
        try:
            message, n, took = differences(spark, con, sf_dir, query, sql.get(name))
        except Exception as error:
            message, n, took = f"{type(error).__name__}: {str(error)[:1500]}", -1, 0.0
        failed += message is not None
        print(f"{'ok  ' if message is None else 'FAIL'} {name:32s} {n:7d} rows {took:6.2f}s")
        if message:
            print("   ", message)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
