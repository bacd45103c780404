"""Run registered queries against DuckDB: python tests/check.py [sf] [name ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return str(value)
    return value


def compare(spark_df, con, sql: str) -> str | None:
    """None when names, types and values agree exactly; else what differs."""
    names = sorted(spark_df.columns)
    got = [tuple(normal(v) for v in r) for r in spark_df.select(*names).collect()]
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} vs {sorted(rel.columns)}"
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "date": "DATE"}
    for name, kind in spark_df.dtypes:
        if kinds.get(kind, kind) != types[name]:
            return f"type of {name}: {kind} vs {types[name]}"
    quoted = ", ".join(f'"{n}"' for n in names)
    want = [tuple(normal(v) for v in r) for r in con.sql(f"SELECT {quoted} FROM ({sql}) AS q").fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    if not got:
        return "no rows"
    key = lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)
    got.sort(key=key)
    want.sort(key=key)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        pairs = [(n, a, b) for n, a, b in zip(names, g, w) if a != b]
        return f"{len(bad)}/{len(got)} rows differ, first: {pairs[:4]} key {g[:4]}"
    return None


def main() -> int:
    from crosspanel.session import build_session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    plans, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, plan in plans.items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        start = time.time()
        try:
            df = plan(spark, sf_dir)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        mark = "ok  " if problem is None else "FAIL"
        failed += problem is not None
        print(f"{mark} {name} {time.time() - start:.1f}s{'' if name in sqls else ' (rows only)'} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
