"""Run registered queries against their SQL: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "~"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "~"
        return repr(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(norm(r[i]) for i in order) for r in rows)


def kind(t: str) -> str:
    t = t.lower()
    if "int" in t and "huge" not in t and "interval" not in t:
        return "int"
    if t in ("double", "float"):
        return "float"
    return {"string": "varchar"}.get(t, t)


def compare(df, con, sql: str):
    """None when equal, else a message."""
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dc, dr = rows_of([c[0] for c in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns {sc} vs {dc}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} vs {len(dr)}; first {sr[:2]} vs {dr[:2]}"
    want = {c[0]: kind(str(c[1])) for c in cur.description}
    have = {f.name: kind(f.dataType.simpleString()) for f in df.schema}
    if want != have:
        return "types " + str({k: (have[k], want[k]) for k in want if have[k] != want[k]})
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)}/{len(sr)} rows differ: {sc} {bad[0][0]} vs {bad[0][1]}"
    return None if sr else "both empty"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from marketlens.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                msg = compare(df, con, sqls[name])
            else:
                n = df.count()
                msg = None if n else "no rows"
                name += f" (rows only: {n})"
        except Exception as e:  # noqa: BLE001 - report and go on
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        failed += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {time.time() - t0:6.2f}s {name} {msg or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
