"""Run registered queries next to their SQL and compare row by row."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(_value(r[i])) for i in order) for r in rows)


def compare(spark, con, folder, name, run, sql) -> str:
    """Empty text when both sides agree, else what differs."""
    df = run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return "" if got else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(set(df.columns) ^ set(names))}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if a == b:
        return ""
    only_spark, only_sql = list((a - b).items())[:2], list((b - a).items())[:2]
    return f"rows {len(got)} vs {len(want)}; order {sorted(names)}\n   spark {only_spark}\n   sql   {only_sql}"


def main(folder: str, wanted: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from flowsieve.session import build_session

    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            problem = compare(spark, con, folder, name, run, oracles.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        took = time.time() - began
        bad += bool(problem)
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {kind:4s} {took:6.2f}s {problem}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
