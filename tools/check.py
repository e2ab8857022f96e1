"""Run registered queries next to their checking SQL and report differences.

usage: python tools/check.py [--sf DIR] [--module NAME] [key ...]
"""

from __future__ import annotations

import argparse
import sys
import time
import traceback
from concurrent.futures import ThreadPoolExecutor
from importlib import import_module
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loanlens.plans import registry  # noqa: E402
from loanlens.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


def plain(v):
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def compare(key, spark, sf):
    t0 = time.time()
    out = registry.QUERIES[key](spark, sf)
    rows = [tuple(plain(v) for v in row) for row in out.collect()]
    took = time.time() - t0
    if key not in registry.CHECKS:
        return f"rows {len(rows)}", took, rows[:2]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    res = con.execute(registry.CHECKS[key])
    names = [d[0] for d in res.description]
    kinds = {d[0]: str(d[1]) for d in res.description}
    want = [tuple(plain(v) for v in row) for row in res.fetchall()]
    if sorted(out.columns) != sorted(names):
        return "COLUMNS", took, (sorted(out.columns), sorted(names))
    bad = [(c, t, kinds[c]) for c, t in out.dtypes
           if KINDS.get(t, t) != kinds[c] and not t.startswith("array")]
    if bad:
        return "TYPES", took, bad
    order = sorted(names)
    left = sorted((tuple(row[out.columns.index(c)] for c in order) for row in rows), key=repr)
    right = sorted((tuple(row[names.index(c)] for c in order) for row in want), key=repr)
    if left != right:
        diff = [(a, b) for a, b in zip(left, right) if a != b][:3]
        return "VALUES", took, (len(left), len(right), order, diff)
    return ("ok" if rows else "EMPTY"), took, len(rows)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("keys", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--module", action="append")
    ap.add_argument("--show", action="store_true")
    args = ap.parse_args()
    if args.module:
        for m in args.module:
            import_module(f"loanlens.plans.{m}")
    else:
        registry.load_all()
    keys = args.keys or list(registry.QUERIES)
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")

    def one(key):
        try:
            return key, *compare(key, spark, args.sf)
        except Exception as exc:  # noqa: BLE001
            tb = traceback.format_exc().strip().splitlines()
            where = [x for x in tb if "loanlens" in x][-1:]
            return key, "ERROR", 0.0, (str(exc)[:500], where)

    bad = 0
    with ThreadPoolExecutor(4) as pool:
        for key, verdict, took, info in pool.map(one, keys):
            fine = verdict == "ok" or verdict.startswith("rows")
            bad += not fine
            if not fine or args.show:
                print(f"{verdict:8s} {key:28s} {took:5.1f}s {info}")
            else:
                print(f"{verdict:8s} {key:28s} {took:5.1f}s")
    print("bad:", bad, "of", len(keys))
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
