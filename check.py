"""Compare every registered query with its SQL twin in DuckDB on the same parquet files.

usage: python check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from trafficward.catalog.all import REGISTRY
from trafficward.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(normal(r[i]) for i in order) for r in rows], key=repr)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    bad = 0
    for name, q in REGISTRY.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = q.run(spark, folder)
            found = [tuple(r) for r in df.collect()]
            took = time.time() - start
            sql = q.twin()
            if sql is None:
                print(f"rows  {name} n={len(found)} {took:.1f}s", flush=True)
                continue
            answer = db.execute(sql)
            names = [d[0] for d in answer.description]
            kinds = [str(d[1]) for d in answer.description]
            expected = answer.fetchall()
            mine, theirs = rows_of(df.columns, found), rows_of(names, expected)
            same = mine == theirs and sorted(df.columns) == sorted(names)
            bad += not same
            print(f"{'ok   ' if same else 'DIFF '} {name} n={len(found)}/{len(expected)} {took:.1f}s", flush=True)
            if not same:
                in_a, in_b = set(mine), set(theirs)
                only_a = [r for r in mine if r not in in_b][:3]
                only_b = [r for r in theirs if r not in in_a][:3]
                print("   columns", sorted(df.columns), kinds, "\n   spark", only_a, "\n   sql  ", only_b, flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name} {type(error).__name__}: {str(error)[:600]}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
