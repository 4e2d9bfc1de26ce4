"""Compare registered queries with their SQL: python -m registry.check DIR [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from canopy.session import local_session


def duck(path: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(path).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and v != v):
        return "~"
    return repr(v)


def compare(left: list[tuple], right: list[tuple]) -> str:
    a = sorted(tuple(map(_cell, r)) for r in left)
    b = sorted(tuple(map(_cell, r)) for r in right)
    if a == b:
        return ""
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; e.g. {sorted(set(a) - set(b))[:2]} vs {sorted(set(b) - set(a))[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)}/{len(a)} rows differ, e.g. {bad[0]}"


def main(path: str, names: list[str]) -> int:
    from registry import load

    queries, oracles = load()
    chosen = [q for q in queries if not names or any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(path)
    failed = 0
    for name in chosen:
        t0 = time.time()
        try:
            df = queries[name](spark, path)
            cols = sorted(df.columns)
            rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
            t1 = time.time()
            if name in oracles:
                rel = con.execute(oracles[name])
                have = [d[0] for d in rel.description]
                order = [have.index(c) for c in cols]
                msg = compare(rows, [tuple(r[i] for i in order) for r in rel.fetchall()])
            else:
                msg = ""
            state = "FAIL" if msg else ("ok" if name in oracles else "rows")
        except Exception as e:  # report and go on to the next query
            t1, rows, state, msg = time.time(), [], "ERROR", str(e)[:700]
        failed += state in ("FAIL", "ERROR")
        nulls = sum(v is None for r in rows for v in r)
        print(f"{state:5s} {name:34s} rows={len(rows):7d} nulls={nulls:6d} {t1 - t0:6.2f}s {msg}", flush=True)
    print(f"{len(chosen)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
