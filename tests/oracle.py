"""Runs registered queries against their SQL in DuckDB and compares the values.

As a script: python -m tests.oracle [--sf DIR] [name ...]
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb
import pandas as pd

from gleanery.plans.catalogue import load
from gleanery.plans.fixtures import TABLES

SF = "/root/testdata/sf0.01"


def duck(folder: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return f"{float(v):.6g}"
    if type(v).__name__.startswith(("int", "uint")):
        return str(int(v))
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, x or "") for x in r))


def compare(spark, con, name: str, run, sql: str | None, folder: str) -> tuple[str, int]:
    df = run(spark, folder)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    mine = [tuple(r) for r in df.collect()]
    if sql is None:
        return ("rows", len(mine))
    rel = con.sql(sql)
    if sorted(types) != sorted(rel.columns):
        return (f"COLUMNS {sorted(types)} / {sorted(rel.columns)}", len(mine))
    kinds = {c: str(k).lower() for c, k in zip(rel.columns, rel.types)}
    names = {"varchar": "string", "integer": "int", "bigint": "bigint", "boolean": "boolean", "double": "double", "date": "date"}
    off = {c: (types[c], kinds[c]) for c in types if names.get(kinds[c], kinds[c]) != types[c]}
    theirs = rel.fetchall()
    a, b = rows_of(df.columns, mine), rows_of(rel.columns, theirs)
    if len(a) != len(b):
        return (f"COUNT {len(a)} / {len(b)}", len(a))
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return (f"VALUES {len(bad)} differ, e.g. {bad[0]}", len(a))
    if off:
        return (f"TYPES {off}", len(a))
    return ("ok", len(a))


def main(argv: list[str]) -> int:
    from gleanery.session import build_session

    folder = SF
    if argv[:1] == ["--sf"]:
        folder, argv = argv[1], argv[2:]
    spark = build_session("8")
    con = duck(folder)
    queries, oracles = load()
    failed = 0
    for name in argv or queries:
        start = time.time()
        try:
            verdict, n = compare(spark, con, name, queries[name], oracles.get(name), folder)
        except Exception as e:  # report and go on: one run shows every failure
            verdict, n = f"ERROR {type(e).__name__}: {str(e)[:700]}", -1
        good = verdict in ("ok", "rows")
        failed += not good
        print(f"{'  ' if good else '! '}{name}: {verdict} [{n} rows, {time.time() - start:.1f}s]", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
