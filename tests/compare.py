"""Run registered queries next to their SQL on DuckDB and compare whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "as_tuple"):
        return float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(left[1]), None, df
    cur = con.execute(sql)
    right = rows_of([d[0] for d in cur.description], cur.fetchall())
    problem = None
    if left[0] != right[0]:
        problem = f"columns {left[0]} != {right[0]}"
    elif len(left[1]) != len(right[1]):
        problem = f"rows {len(left[1])} != {len(right[1])}"
    elif left[1] != right[1]:
        diff = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
        problem = f"{len(diff)} rows differ, first {diff[0]}"
    return problem, len(left[1]), len(right[1]), df


def main(argv):
    import __spark_entry__ as entry
    from contactloom.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in names:
        started = time.time()
        try:
            problem, n, m, _ = compare(spark, con, sf_dir, queries[name], oracle.get(name))
        except Exception as error:  # report and go on with the next query
            problem, n, m = f"{type(error).__name__}: {str(error)[:1500]}", None, None
        bad += problem is not None
        note = "rows only" if name not in oracle else ""
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} rows={n} {time.time() - started:6.2f}s {note} {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} good")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
