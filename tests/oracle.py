"""Run registered queries next to their SQL: ``python tests/oracle.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        return _cell(v.item())
    if type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_rows, got_cols = [tuple(r) for r in df.collect()], df.columns
    if sql is None:
        return f"rows-only n={len(got_rows)}", None
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    want_rows = res.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"COLUMNS {sorted(got_cols)} != {sorted(want_cols)}", False
    a, b = normal(got_rows, got_cols), normal(want_rows, want_cols)
    if a == b:
        return f"ok n={len(a)}", True
    diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
    return f"DIFF n={len(a)} vs {len(b)} first={diff} cols={sorted(got_cols)}", False


def main():
    from catalogue import ORACLES, QUERIES
    from tests.conftest import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = build_session(), duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if names and not any(n in name for n in names):
            continue
        t0 = time.time()
        try:
            msg, ok = compare(spark, con, name, fn, ORACLES.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            msg, ok = f"ERROR {type(e).__name__}: {str(e)[:1500]}", False
        bad += ok is False
        print(f"{time.time() - t0:6.1f}s {name}: {msg[:2500]}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
