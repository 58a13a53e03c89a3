"""Compare registered queries with their SQL twins on the parquet tables.

Usage: ``python -m tests.oracle [--sf 0.001] [name ...]``
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return ("f", repr(value))
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, bytearray):
        return bytes(value)
    return (type(value).__name__, str(value))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    """(matches, message) for one query."""
    df = query(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for pairing in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if pairing in plan:
            return False, f"the plan holds a {pairing}"
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(got)} rows (no oracle)"
    cur = con.execute(sql)
    want_cols, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        only = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return False, f"rows {len(got)} != {len(want)}: spark only {only[0]} duckdb only {only[1]}"
    if got != want:
        a, b = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return False, f"{len(a)} rows differ:\n   spark  {str(a[:3])[:900]}\n   duckdb {str(b[:3])[:900]}"
    return True, f"{len(got)} rows"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.001")
    parser.add_argument("--zone", default="UTC")
    args = parser.parse_args()
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", args.zone)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = str(DATA / f"sf{args.sf}")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            ok, message = compare(spark, con, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, message = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {message}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
