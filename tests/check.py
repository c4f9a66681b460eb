"""Run registered queries beside their SQL and compare the rows.

    python -m tests.check [folder] [name part ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from tidewell.catalog import ORACLES, QUERIES
from tidewell.session import get_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(x):
        return None if isinstance(x, float) and math.isnan(x) else x

    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, int]:
    """Outcome text (empty when equal) and the number of rows."""
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return "", len(got)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}", len(got)
    a, b = _rows(df.columns, got), _rows(names, want)
    if a == b:
        return "", len(got)
    only_a, only_b = a - b, b - a
    return (
        f"rows {len(got)} / {len(want)}, differing {sum(only_a.values())} / {sum(only_b.values())}\n"
        f"  spark {sorted(only_a, key=str)[:3]}\n  sql   {sorted(only_b, key=str)[:3]}"
    ), len(got)


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in QUERIES:
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            outcome, n = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the others
            outcome, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += bool(outcome)
        print(f"{'ok  ' if not outcome else 'BAD '} {name} rows={n} {time.time() - start:.2f}s {outcome}", flush=True)
    print(f"{bad} differing")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
