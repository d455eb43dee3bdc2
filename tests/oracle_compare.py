"""Run registered queries on Spark and DuckDB side by side and compare the rows.

Usage: python -m tests.oracle_compare [sf] [name-prefix …]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else ("f", value + 0.0)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    return (type(value).__name__, str(value))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(canonical(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a short account of the difference."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; spark {got[:2]} duck {want[:2]}"
    diffs = [(g, w) for g, w in zip(got, want) if g != w]
    if diffs:
        g, w = diffs[0]
        cols = sorted(names)
        cells = [(c, a, b) for c, a, b in zip(cols, g, w) if a != b]
        return f"{len(diffs)} of {len(got)} rows differ, e.g. {cells}"
    if not got:
        return "equal but empty"
    return None


def main(argv):
    import __spark_entry__ as entry
    from propspark.session import build_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", cores=8, shuffle_partitions=8, memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        t0 = time.time()
        try:
            problem = compare(spark, con, fn, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - a report, not control flow
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        kind = "sql " if name in sqls else "rows"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {kind} {time.time() - t0:6.2f}s {name} {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
