"""Run registered queries and their SQL twins side by side and report differences."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in RAW.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(spark, con, name: str, fn, sql: str | None, folder: str) -> tuple[str, float, float]:
    t0 = time.time()
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(rows)}", t1 - t0, 0.0
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    t2 = time.time()
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(columns)}", t1 - t0, t2 - t1
    if len(rows) != len(expected):
        return f"ROWS {len(rows)} vs {len(expected)}", t1 - t0, t2 - t1
    got, want = canonical(df.columns, rows), canonical(columns, expected)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"VALUES {len(bad)} of {len(got)} differ\n      {bad[0][0]}\n      {bad[0][1]}", t1 - t0, t2 - t1
    return f"ok {len(rows)}", t1 - t0, t2 - t1


def main() -> None:
    from outflow.session import build_session

    import __spark_entry__ as entry

    scale = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    prefixes = tuple(sys.argv[2:])
    folder = f"/root/testdata/{scale}"
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    fns, sqls = entry.queries(), entry.oracle_sql()
    failed = []
    for name in fns:
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            verdict, spark_s, duck_s = compare(spark, con, name, fns[name], sqls.get(name), folder)
        except Exception as exc:  # report and go on
            verdict, spark_s, duck_s = f"ERROR {type(exc).__name__}: {str(exc)[:700]}", 0.0, 0.0
        if not verdict.startswith(("ok", "rows-only")):
            failed.append(name)
        print(f"{name:45s} {spark_s:7.2f}s {duck_s:6.2f}s  {verdict}", flush=True)
    print("FAILED:", failed or "none")


if __name__ == "__main__":
    main()
