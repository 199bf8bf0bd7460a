"""Runs registered queries against DuckDB on the driver tables: python tests/check_oracle.py [sf] [name-part ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from hourgrid.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def normal(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str) -> str:
    df = contract.queries()[name](spark, folder)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    text = contract.oracle_sql().get(name)
    if text is None:
        return f"rows {len(got)}"
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    want = normal(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} vs {sorted(names)}"
    if got == want:
        return f"ok {len(got)}"
    a, b = set(map(repr, got)), set(map(repr, want))
    only, lack = sorted(a - b)[:3], sorted(b - a)[:3]
    return f"FAIL rows {len(got)} vs {len(want)}; differing {len(a - b)}/{len(b - a)}\n   spark {only}\n   sql   {lack}\n   cols {sorted(names)}"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(), database(folder)
    bad = 0
    for name in contract.queries():
        if parts and not any(name.startswith(p) or p in name for p in parts):
            continue
        start = time.time()
        try:
            result = compare(spark, con, folder, name)
        except Exception as problem:  # report and go on to the next query
            result = f"FAIL {type(problem).__name__}: {str(problem)[:900]}"
        bad += result.startswith("FAIL")
        if result.startswith("FAIL") or parts or time.time() - start > 4:
            print(f"{name}: {result} [{time.time() - start:.1f}s]", flush=True)
    print("failures:", bad, "of", len(contract.queries()))


if __name__ == "__main__":
    main()
