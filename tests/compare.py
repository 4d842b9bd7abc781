"""Runs queries and their DuckDB checks side by side.

    python tests/compare.py [--sf 0.01] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows-only {len(got)}"
    result = con.execute(sql)
    want, want_cols = rows_of([d[0] for d in result.description], result.fetchall())
    kinds = {c: t for c, t in zip([d[0] for d in result.description], [str(d[1]) for d in result.description])}
    wide = [c for c, t in kinds.items() if "HUGEINT" in t or "DECIMAL" in t or "[" in t]
    if got_cols != want_cols:
        return f"COLUMNS {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w]
        return f"VALUES differ in {len(diff)} of {len(got)}: {diff[:2]}"
    types = dict(df.dtypes)
    for c, t in kinds.items():
        s = types[c]
        if ("INT" in t) != ("int" in s) or ("DOUBLE" in t) != (s == "double"):
            return f"TYPE {c}: {s} against {t}"
    if not got:
        return "EMPTY"
    return f"ok {len(got)}" + (f" (check types {wide})" if wide else "")


def main(argv):
    sys.path.insert(0, str(ROOT))
    from logloom.session import build_session
    import __spark_entry__ as entry

    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if argv and not any(a in name for a in argv):
            continue
        t = time.time()
        try:
            said = compare(spark, con, fn, checks.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            said = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        if not said.startswith(("ok", "rows-only")):
            bad.append(name)
        print(f"{name:32s} {time.time() - t:6.2f}s {said}", flush=True)
    print(f"{len(bad)} not ok: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
