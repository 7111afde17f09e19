"""Run queries in Spark and DuckDB and compare whole results.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from checks.queries import REGISTRY

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def difference(spark, db, sf_dir: str, name: str) -> str | None:
    """None when equal, otherwise what differs."""
    query, sql = REGISTRY[name]
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    if sql is None:
        return None if got else "no rows"
    result = db.sql(sql)
    if sorted(result.columns) != columns:
        return f"columns {columns} != {sorted(result.columns)}"
    want = Counter(db.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql})").fetchall())
    if got == want:
        return None
    return (
        f"{got.total()} rows, expected {want.total()}; "
        f"only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    )


def main() -> int:
    from pyspark.sql import SparkSession

    from kindred.session import configure

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    spark = configure(builder.config("spark.ui.enabled", "false")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db, failed = oracle(sf_dir), 0
    for name in args or REGISTRY:
        start = time.time()
        try:
            problem = difference(spark, db, sf_dir, name)
        except Exception as error:  # keep going: one report for all queries
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
