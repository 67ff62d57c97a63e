"""Compare every catalog query with its oracle: ``python check_oracles.py [sf_dir] [query ...]``."""

import sys
import time

import duckdb

from laudospark.plans.catalog import QUERIES
from laudospark.plans.oracle import ORACLES
from laudospark.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf)
            ours = rows_of(df.columns, df.collect())
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows-only {name} {len(ours)} {took:.2f}s", flush=True)
                continue
            rel = con.sql(ORACLES[name])
            theirs = rows_of(rel.columns, rel.fetchall())
            same = sorted(df.columns) == sorted(rel.columns) and ours == theirs
            print(f"{'ok  ' if same else 'DIFF'} {name} {len(ours)} {len(theirs)} {took:.2f}s", flush=True)
            if not same:
                bad += 1
                print("   ", sorted(df.columns), sorted(rel.columns))
                diff = [(a, b) for a, b in zip(ours, theirs) if a != b][:1]
                print("   ", str(diff)[:700])
        except Exception as error:
            bad += 1
            print(f"FAIL {name} {str(error)[:500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
