"""Run registered queries and their SQL counterparts side by side.

python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(spark, con, fn, sql: str, sf_dir: str) -> tuple[int, list]:
    df = fn(spark, sf_dir)
    left_cols, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right_cols, right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left_cols != right_cols:
        return len(left), [("columns", left_cols, right_cols)]
    if not left:
        return 0, [("empty", "a comparison of no rows shows nothing")]
    if left == right:
        return len(left), []
    l, r = set(map(repr, left)), set(map(repr, right))
    return len(left), [("rows", len(left), len(right)), *[("spark", x) for x in sorted(l - r)[:3]], *[("sql", x) for x in sorted(r - l)[:3]]]


def main() -> int:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="leadflow-compare-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name not in sqls:
                print(f"{name}: {fn(spark, sf_dir).count()} rows, no SQL, {time.time() - start:.1f}s", flush=True)
                continue
            n, diff = differences(spark, con, fn, sqls[name], sf_dir)
        except Exception as e:  # report and go on with the next query
            n, diff = 0, [("error", str(e)[:1500])]
        bad += bool(diff)
        print(f"{name}: {n} rows, {'OK' if not diff else 'DIFFERENT'}, {time.time() - start:.1f}s", flush=True)
        for d in diff:
            print("   ", *d, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
