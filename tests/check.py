"""Compare every registered query with its oracle SQL on DuckDB.

Run as ``python tests/check.py [--sf DIR] [name-pattern ...]``; the pytest wrapper uses ``compare``.
"""

from __future__ import annotations

import datetime as dt
import re
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _sorted(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    data = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(data, key=lambda t: tuple((x is None, str(x)) for x in t)), [cols[i] for i in order]


def compare(df, con, sql):
    """(ok, message)."""
    rel = con.sql(sql)
    got, gc = _sorted([tuple(r) for r in df.collect()], df.columns)
    exp, ec = _sorted(rel.fetchall(), rel.columns)
    if gc != ec:
        return False, f"columns {gc} vs {ec}"
    if len(got) != len(exp):
        return False, f"rows {len(got)} vs {len(exp)}; e.g. {sorted(set(map(repr, got)) - set(map(repr, exp)))[:2]} / {sorted(set(map(repr, exp)) - set(map(repr, got)))[:2]}"
    bad = [(a, b) for a, b in zip(got, exp) if repr(a) != repr(b)]
    if bad:
        return False, f"{len(bad)}/{len(got)} rows differ, cols {gc}: {bad[0][0]} vs {bad[0][1]}"
    nulls = [c for i, c in enumerate(gc) if got and all(r[i] is None for r in got)]
    return True, f"{len(got)} rows" + (f" ALL-NULL {nulls}" if nulls else "") + ("" if got else " EMPTY")


def main(argv):
    from panelspark.plans import load_all
    from panelspark.session import local_session

    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i:i + 2]
    import logging
    logging.disable(logging.CRITICAL)
    spark = local_session(cores=8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    bad = 0
    for name, q in load_all().items():
        if argv and not any(re.search(p, name) for p in argv):
            continue
        t = time.time()
        try:
            if q.sql is None:
                ok, msg = True, f"no oracle, {len(q.run(spark, sf).collect())} rows"
            else:
                ok, msg = compare(q.run(spark, sf), con, q.sql)
        except Exception as e:  # noqa: BLE001 - the harness reports every failure
            ok, msg = False, f"{type(e).__name__}: {str(e)[:500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:42s} {time.time() - t:5.1f}s {msg}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
