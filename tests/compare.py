"""Run registered queries beside their SQL checks and compare whole results.

Usage: python tests/compare.py [scale] [name ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


SAME_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean",
}


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return (0, str(v))
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            return (0, str(v))
        return (1, float(f"{v:.9g}") + 0.0)
    if isinstance(v, int):
        return (1, float(v))
    if isinstance(v, datetime.datetime):
        return (0, v.strftime("%Y-%m-%d %H:%M:%S.%f"))
    if isinstance(v, (list, tuple)):
        return (0, str([norm(x) for x in v]))
    return (0, str(v))


def same(a, b) -> bool:
    if a[0] == b[0] == 1:
        return math.isclose(a[1], b[1], rel_tol=1e-7, abs_tol=1e-9)
    return a == b


def compare(spark_rows, spark_cols, duck_rows, duck_cols) -> str:
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} vs {sorted(duck_cols)}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} vs {len(duck_rows)}"
    order = sorted(range(len(spark_cols)), key=lambda i: spark_cols[i])
    dorder = sorted(range(len(duck_cols)), key=lambda i: duck_cols[i])
    left = sorted(tuple(norm(r[i]) for i in order) for r in spark_rows)
    right = sorted(tuple(norm(r[i]) for i in dorder) for r in duck_rows)
    bad = [(x, y) for x, y in zip(left, right) if not all(same(p, q) for p, q in zip(x, y))]
    return f"{len(bad)} differing rows, first {bad[0]}" if bad else ""


def run(spark, con, name, fn, sql, sf) -> tuple[str, int, float]:
    start = time.time()
    df = fn(spark, sf)
    rows = df.collect()
    took = time.time() - start
    if sql is None:
        return "rows-only", len(rows), took
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    kinds = {r[0]: SAME_TYPES.get(r[1], r[1]) for r in described}
    odd = {n: (t, kinds.get(n)) for n, t in df.dtypes if kinds.get(n) != t}
    duck = con.execute(sql).fetchall()
    verdict = compare([tuple(r) for r in rows], df.columns, duck, [r[0] for r in described])
    return verdict or (f"types {odd}" if odd else ""), len(rows), took


def main() -> int:
    import traceback

    import __spark_entry__ as entry
    from obsframe.session import get_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf = f"/root/testdata/sf{scale}"
    spark = get_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, checks = entry.queries(), entry.oracle_sql()
    failures = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            verdict, n, took = run(spark, con, name, fn, checks.get(name), sf)
        except Exception as e:  # noqa: BLE001
            verdict, n, took = "ERROR " + " ".join(traceback.format_exception_only(e))[:700], -1, 0.0
        ok = verdict in ("", "rows-only") and n > 0
        failures += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} rows={n:<8d} {took:6.2f}s {verdict}", flush=True)
    print("failures", failures, "of", len(queries))
    spark.stop()
    return 1 if failures else 0


if __name__ == "__main__":
    raise SystemExit(main())
