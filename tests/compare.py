"""Run registered queries next to their DuckDB SQL and compare every value.

``python -m tests.compare [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as driver

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def local_session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pairlens-tests")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def type_differences(df, con, sql: str) -> dict[str, tuple[str, str]]:
    found = {row[0]: row[1] for row in con.execute("DESCRIBE " + sql).fetchall()}
    return {c: (t, found[c]) for c, t in df.dtypes if SQL_TYPES.get(t, t) != found[c]}


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (value + 0.0 if value else 0.0)
    if hasattr(value, "item"):
        return _plain(value.item())
    return float(value) if type(value).__name__ == "Decimal" else value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def same(a: tuple, b: tuple, tolerance: float) -> bool:
    for x, y in zip(a, b):
        if isinstance(x, float) and isinstance(y, float):
            if not math.isclose(x, y, rel_tol=tolerance, abs_tol=tolerance):
                return False
        elif x != y:
            return False
    return True


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> tuple[str, int, float]:
    """('exact' | 'close' | 'rows-only' | what differs, row count, seconds)."""
    start = time.time()
    df = driver.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    seconds = time.time() - start
    sql = driver.oracle_sql().get(name)
    if sql is None:
        return ("rows-only" if got else "no rows"), len(got), seconds
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got), seconds
    types = type_differences(df, con, sql)
    if types:
        return f"types {types}", len(got), seconds
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}", len(got), seconds
    if got == want:
        return "exact", len(got), seconds
    # Sorting may differ where values differ in the last digit only.
    if all(same(a, b, 1e-5) for a, b in zip(got, want)):
        return "close", len(got), seconds
    bad = next((a, b) for a, b in zip(got, want) if not same(a, b, 1e-5))
    return f"differs: {str(bad)[:600]}", len(got), seconds


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session, connection = local_session(), duck(sf)
    for query in sys.argv[2:] or driver.queries():
        try:
            verdict, n, secs = compare(session, connection, query, sf)
        except Exception as exc:  # report and go on with the next query
            verdict, n, secs = f"ERROR {type(exc).__name__}: {str(exc)[:700]}", 0, 0.0
        print(f"{query:34s} {n:7d} rows {secs:7.2f}s  {verdict}", flush=True)
