"""Runs registered queries beside their oracles and reports differences."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "" if value is None else f"{type(value).__name__}:{value}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got_names, got = df.columns, df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None
    cursor = con.execute(sql)
    want_names, want = [c[0] for c in cursor.description], cursor.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if a == b:
        return None if a else "no rows"
    only_a, only_b = [r for r in a if r not in set(b)], [r for r in b if r not in set(a)]
    return f"{len(a)} rows against {len(b)}; only here {only_a[:3]}; only there {only_b[:3]}"


if __name__ == "__main__":
    from tidegate.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    session = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                            "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or list(entry.queries())
    db, bad = connect(sf), 0
    for key in [k for k in entry.queries() if any(k.startswith(n) for n in names)]:
        started = time.time()
        try:
            fault = compare(session, db, sf, key)
        except Exception as error:  # noqa: BLE001
            fault = f"{type(error).__name__}: {str(error)[:700]}"
        bad += fault is not None
        print(f"{'ok  ' if fault is None else 'FAIL'} {key} {time.time() - started:.1f}s {fault or ''}"[:1500], flush=True)
    print("failures:", bad)
