"""Run registered queries next to their SQL on the same tables and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, float):
        if math.isnan(x):
            return "NaN"
        return 0.0 if x == 0 else (int(x) if x == int(x) and abs(x) < 1e15 else x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def normal(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf: str, query, sql: str):
    """Returns (ok, message)."""
    df = query(spark, sf)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = normal([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        miss = [r for r in want[1] if r not in set(got[1])][:3]
        return False, f"rows {len(got[1])} != {len(want[1])}\n  extra {extra}\n  missing {miss}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(got[1])} rows differ\n  got  {bad[0][0]}\n  want {bad[0][1]}"
    return True, f"{len(got[1])} rows"


def main() -> None:
    import __spark_entry__ as entry
    from tests.sessions import local_session

    spark = local_session()
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = duck(sf)
    pick = sys.argv[1:]
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if pick and not any(name.startswith(p) for p in pick):
            continue
        start = time.time()
        try:
            if name in oracles:
                ok, message = compare(spark, con, sf, query, oracles[name])
            else:
                ok, message = True, f"{query(spark, sf).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            ok, message = False, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - start:6.1f}s {name}: {message}", flush=True)


if __name__ == "__main__":
    main()
