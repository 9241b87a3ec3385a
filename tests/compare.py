"""Run registered queries beside their SQL and compare whole results.

Usage: python tests/compare.py SF_DIR [query ...]
"""

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


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want_names, want = rows_of(rel.columns, rel.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    spark_types = dict((c, t) for c, t in df.dtypes)
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    off = [(c, spark_types[c], str(t)) for c, t in zip(rel.columns, rel.types) if kinds.get(spark_types[c]) != str(t)]
    if got != want:
        extra, missing = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} rows vs {len(want)}; extra {sorted(extra)[:3]} missing {sorted(missing)[:3]} types {off}"
    return None if not off else f"types differ {off}"


def main() -> None:
    import __spark_entry__ as entry
    from treelode.session import build_session

    spark = build_session(master="local[8]", conf={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = connect(sf_dir)
    bad = 0
    for name in wanted or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem = compare(df, con, oracles[name]) if name in oracles else f"(no SQL) {df.count()} rows"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None and not problem.startswith("(no SQL)")
        print(f"{name:28s} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
