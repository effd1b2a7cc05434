"""Compare the registered queries with their SQL counterparts in DuckDB.

Run as ``python -m tests.harness [sf] [key ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return ("DECIMAL", str(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """Return None when equal, else a description of the difference."""
    got_columns = df.columns
    got = _rows(got_columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    want = _rows(want_columns, cur.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}", len(got)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    want_types = {d[0]: str(d[1]) for d in cur.description}
    bad = {n: (t, want_types[n]) for n, t in df.dtypes if kinds.get(t) != want_types[n]}
    if bad:
        return f"types {bad}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; e.g. {[r for r in got if r not in set(want)][:2]} {[r for r in want if r not in set(got)][:2]}", len(got)
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        return f"{len(diff)} of {len(got)} rows differ, e.g. {sorted(got_columns)} {diff[0]}", len(got)
    return None, len(got)


def main(argv):
    from tidewatch.plans import ORACLES, QUERIES, load_all
    from tidewatch.session import local_session

    load_all()
    sf = argv[0] if argv else "0.01"
    keys = argv[1:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(sf_dir)
    failed = []
    for key in keys:
        start = time.time()
        try:
            df = QUERIES[key](spark, sf_dir)
            if key in ORACLES:
                problem, n = compare(df, con, ORACLES[key])
            else:
                problem, n = None, df.count()
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {key:28s} rows={n:<7d} {time.time() - start:6.2f}s{'' if key in ORACLES else ' (no oracle)'} {problem or ''}", flush=True)
        if problem:
            failed.append(key)
    print(f"{len(keys) - len(failed)} ok, {len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
