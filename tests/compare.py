"""Run registered queries against their DuckDB statements: `python tests/compare.py sf0.01 [name…]`."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (int, str)) or value is None:
        return repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def compare(spark, con, name, query, sql, sf_dir):
    """(ok, message) for one query."""
    started = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - started
    if sql is None:
        return True, f"{len(got)} rows, {took:.2f}s, no statement"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return False, f"columns differ: {sorted(set(df.columns) ^ set(columns))}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return False, f"{len(got)} vs {len(want)} rows; extra {extra}; missing {missing}"
    return True, f"{len(got)} rows, {took:.2f}s"


def main() -> int:
    import __spark_entry__ as contract
    from wirelens.session import build_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="wirelens-compare-"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, statements = contract.queries(), contract.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        try:
            ok, message = compare(spark, con, name, queries[name], statements.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, message, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
