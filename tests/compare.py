"""Run registered queries and their SQL side by side; ``python tests/compare.py DIR [names]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    return [names[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=key
    )


def compare(df, con, sql) -> str | None:
    """What differs, or None."""
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_names, want = rows_of([d[0] for d in res.description], res.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got == want:
        return None
    extra, missing = set(got) - set(want), set(want) - set(got)
    show = lambda s: [str(x)[:300] for x in sorted(s, key=str)[:2]]
    return f"{len(got)} rows, want {len(want)}; extra {len(extra)} {show(extra)}; missing {len(missing)} {show(missing)}"


def main(folder: str, only: list[str]) -> int:
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from textquarry.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), e.oracle_sql(), 0
    for name, fn in e.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(fn(spark, folder), con, sql[name])
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                note = f"rows only: {len(fn(spark, folder).collect())}"
                problem = None
        except Exception as ex:  # noqa: BLE001
            problem = note = f"FAIL {type(ex).__name__} {str(ex)[:1200]}"
        bad += problem is not None
        print(f"{name:30s} {time.time() - start:6.2f}s {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
