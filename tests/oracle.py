"""Runs registered queries next to their reference statements and compares whole results.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(root: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (bool, int)):
        return repr(value)
    return str(value)


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(frame, con, sql: str) -> str | None:
    """None when equal, else a description of the first difference."""
    got_columns, got = normal_rows(frame.columns, [tuple(r) for r in frame.collect()])
    relation = con.sql(sql)
    want_columns, want = normal_rows(relation.columns, relation.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        extra, lack = set(got) - set(want), set(want) - set(got)
        return f"rows {len(got)} != {len(want)}; extra {list(extra)[:2]}, missing {list(lack)[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{sum(x != y for x, y in zip(got, want))} rows differ, e.g. {a} != {b}"
    kinds = dict(frame.dtypes)
    for name, kind in zip(relation.columns, relation.types):
        ours, theirs = kinds[name], str(kind).lower()
        if ("int" in ours) != ("int" in theirs) or (ours == "double") != (theirs == "double"):
            return f"type of {name}: {ours} against {theirs}"
        if "hugeint" in theirs or (ours == "bigint") != (theirs == "bigint") and "int" in ours:
            print(f"    note: {name} is {ours} against {theirs}")
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tidewater.session import build_session

    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("oracle", master="local[8]", shuffle_partitions=8,
                          extra={"spark.driver.memory": "12g", "spark.ui.enabled": "false",
                                 "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, statements, bad = connect(root), oracle_sql(), 0
    for name, run in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            frame = run(spark, root)
            if name in statements:
                problem = compare(frame, con, statements[name])
                rows = ""
            else:
                problem, rows = None, f" rows={frame.count()} (no statement)"
        except Exception as error:  # report and go on with the next query
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - started:.1f}s{rows} {problem or ''}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
