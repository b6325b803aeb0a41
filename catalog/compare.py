"""Runs queries next to their oracles: ``python -m catalog.compare [--sf DIR] [name ...]``."""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import time
import traceback

import duckdb

from catalog import load
from catalog.bridge import TABLES


def plain(value):
    """A value both engines can agree on."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def check(spark, con, name: str, sf_dir: str) -> str:
    """'' where the query and its oracle agree, otherwise what differs."""
    queries, oracles = load()
    df = queries[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in oracles:
        return "" if got else "no rows"
    result = con.execute(oracles[name])
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    want = rows_of(columns, result.fetchall())
    if not want and got:
        return "the oracle has no rows"
    if len(got) != len(want):
        extra = [x for x in got if x not in set(want)][:2] if len(got) < 100000 else []
        lost = [x for x in want if x not in set(got)][:2] if len(want) < 100000 else []
        return f"rows {len(got)} != {len(want)}; columns {sorted(columns)}; only spark {extra}; only oracle {lost}"
    if got != want:
        extra, lost = set(got) - set(want), set(want) - set(got)
        pairs = f"only spark {sorted(extra, key=repr)[:2]}; only oracle {sorted(lost, key=repr)[:2]}"
        return f"{len(extra)} of {len(got)} rows differ; columns {sorted(columns)}; {pairs}"
    return ""


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from ratecraft.session import build_session

    conf = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"}
    spark = build_session("local[8]", "compare", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    names = args.names or list(load()[0])
    if names[0].startswith("@"):
        modules = [n[1:] for n in names]
        names = [n for n in load()[0] if any(load()[0][n].__closure__[0].cell_contents.__module__.endswith(m) for m in modules)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = check(spark, con, name, args.sf)
        except Exception:
            problem = traceback.format_exc(limit=3)[-1500:]
        bad += bool(problem)
        mark = "" if name in load()[1] else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name}{mark} {time.time() - start:.1f}s {problem[:2500]}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
