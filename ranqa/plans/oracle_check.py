"""Side-by-side check of a registered query against its SQL oracle in DuckDB.

Compares row count, column names and an order-insensitive digest of values.
Usage: ``python -m ranqa.plans.oracle_check [sf_dir] [name ...]``.
"""

from __future__ import annotations

import hashlib
import json
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> tuple[int, list[str], str, list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]
    return len(rows), sorted(columns), h, lines


def check(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    from ranqa.plans import all_queries

    reg = all_queries()
    con = duck(sf_dir)
    out = {}
    for name in names or list(reg):
        q = reg[name]
        t0 = time.time()
        sdf = q.build(spark, sf_dir)
        srows = [tuple(r) for r in sdf.collect()]
        s = digest(sdf.columns, srows)
        t1 = time.time()
        if q.sql is None:
            out[name] = {"rows": s[0], "oracle": None, "spark_s": round(t1 - t0, 2)}
            if verbose:
                print(f"{name:28s} rows={s[0]:7d} (no oracle) {t1 - t0:.1f}s", flush=True)
            continue
        res = con.execute(q.sql)
        cols = [d[0] for d in res.description]
        drows = [tuple(r) for r in res.fetchall()]
        d = digest(cols, drows)
        ok = s[0] == d[0] and s[1] == d[1] and s[2] == d[2]
        out[name] = {"rows": s[0], "oracle_rows": d[0], "schema_ok": s[1] == d[1], "match": ok,
                     "spark_s": round(t1 - t0, 2)}
        if verbose:
            print(f"{name:28s} rows={s[0]:7d}/{d[0]:7d} schema={'ok' if s[1] == d[1] else 'DIFF'} "
                  f"{'MATCH' if ok else 'MISMATCH'} {t1 - t0:.1f}s", flush=True)
            if not ok:
                if s[1] != d[1]:
                    print("   spark cols:", s[1], "\n   sql cols:  ", d[1])
                only_s = sorted(set(s[3]) - set(d[3]))[:5]
                only_d = sorted(set(d[3]) - set(s[3]))[:5]
                for x in only_s:
                    print("   spark only:", x[:300])
                for x in only_d:
                    print("   sql only:  ", x[:300])
    return out


if __name__ == "__main__":
    from ranqa.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    res = check(get_session(), sf, names)
    bad = [k for k, v in res.items() if v.get("match") is False]
    print(json.dumps({"checked": len(res), "mismatch": bad}))
