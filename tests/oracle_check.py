"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, columns and exact value equality.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import datetime
import decimal

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime) and v.tzinfo is not None:
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return v


def canon(cols: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(scols, srows, ocols, orows) -> tuple[bool, str]:
    if sorted(scols) != sorted(ocols):
        return False, f"columns differ: {sorted(set(scols) ^ set(ocols))}"
    if len(srows) != len(orows):
        return False, f"rows {len(srows)} vs {len(orows)}"
    a, b = canon(scols, srows), canon(ocols, orows)
    cols = sorted(scols)
    for ra, rb in zip(a, b):
        for c, x, y in zip(cols, ra, rb):
            if x == y:
                continue
            if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
                if float(x) == float(y):
                    continue
            return False, f"first diff in {c}: {x!r} vs {y!r}"
    return True, "ok"


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as entry
    from funnelworks.session import get_spark
    spark = get_spark("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, oracles = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(qs):
        t = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            scols, srows = sdf.columns, [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t
        if name not in oracles:
            print(f"{name:32s} rows={len(srows):6d} (no oracle) {ts:.2f}s")
            continue
        try:
            cur = con.execute(oracles[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} ORACLE ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ok, msg = compare(scols, srows, ocols, orows)
        bad += not ok
        print(f"{name:32s} rows={len(srows):6d} {'PASS' if ok else 'FAIL'} {msg} {ts:.2f}s")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
