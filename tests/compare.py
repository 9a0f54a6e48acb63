"""Run registered queries next to their SQL twins:  python tests/compare.py <sf_dir> [name ...]"""

from __future__ import annotations

import os
import sys
import tempfile
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_tuple"):
        return repr(float(v))
    return v


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def difference(df, con, sql) -> str | None:
    """None when both sides give the same columns and rows."""
    got = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(cols)}"
    if got != want:
        return (
            f"{sum(got.values())} rows <> {sum(want.values())}; "
            f"only spark {list((got - want).items())[:3]}; only sql {list((want - got).items())[:3]}"
        )
    return None if got else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quirewise-compare-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    folder, names = sys.argv[1], sys.argv[2:]
    con = oracle_connection(folder)
    for name, fn in e.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            df = fn(session, folder)
            sql = e.oracle_sql().get(name)
            verdict = difference(df, con, sql) if sql else f"rows only: {df.count()}"
        except Exception as problem:  # noqa: BLE001
            verdict = f"{type(problem).__name__}: {str(problem)[:700]}"
        print(f"{name:28s} {time.time() - started:6.2f}s  {verdict or 'ok'}", flush=True)
