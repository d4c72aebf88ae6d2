"""Run catalog queries against their DuckDB oracles and report differences.

    python tools/check.py [--sf DIR] [--only substring ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from boutline.catalog import ORACLES, QUERIES
from boutline.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("null", "")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, float):
        return ("f", f"{v + 0.0:.6f}".replace("-0.000000", "0.000000"))
    if isinstance(v, int):
        return ("i", str(v))
    return (type(v).__name__, str(v))


def compare(name, got, cols, want, wcols):
    a, b = sorted(cols), sorted(wcols)
    if a != b:
        return f"columns {a} vs {b}"
    ia, ib = [cols.index(c) for c in a], [wcols.index(c) for c in b]
    x = sorted(tuple(norm(r[i]) for i in ia) for r in got)
    y = sorted(tuple(norm(r[i]) for i in ib) for r in want)
    if len(x) != len(y):
        sx, sy = set(x), set(y)
        return f"rows {len(x)} vs {len(y)}; only ours {sorted(sx - sy)[:2]}; only oracle {sorted(sy - sx)[:2]}"
    bad = [(p, q) for p, q in zip(x, y) if p != q]
    if bad:
        return f"{len(bad)}/{len(x)} rows differ on {a}: {bad[0][0]} vs {bad[0][1]}"
    return None


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", nargs="*")
    ap.add_argument("--threads", type=int, default=4)
    a = ap.parse_args()
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in QUERIES if not a.only or any(o in n for o in a.only)]

    def one(n):
        t = time.time()
        try:
            df = QUERIES[n](spark, a.sf)
            got = [tuple(r) for r in df.collect()]
            t = time.time() - t
            if n not in ORACLES:
                return n, t, f"rows only ({len(got)})" if got else "NO ROWS", True
            con = duckdb.connect()
            for tb in TABLES:
                con.execute(f"CREATE VIEW {tb} AS SELECT * FROM '{a.sf}/{tb}.parquet'")
            cur = con.execute(ORACLES[n])
            want = cur.fetchall()
            wcols = [d[0] for d in cur.description]
            msg = compare(n, got, df.columns, want, wcols)
            if msg is None and not got:
                msg = "both empty"
            return n, t, msg or f"ok ({len(got)})", msg is None
        except Exception as e:  # noqa: BLE001
            return n, time.time() - t, f"{type(e).__name__}: {str(e)[:700]}", False

    with ThreadPoolExecutor(a.threads) as ex:
        res = list(ex.map(one, names))
    bad = 0
    for n, t, msg, ok in res:
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {t:6.1f}s {n}: {msg}")
    print(f"{len(res) - bad}/{len(res)} good; {sum(r[1] for r in res):.0f}s of query time")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
