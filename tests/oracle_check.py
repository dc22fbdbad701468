"""Compare registered queries with their SQL in DuckDB.

Also a tool: ``python tests/oracle_check.py /root/testdata/sf0.01 [name ...]``.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "HUGEINT": "huge"}


def compare(spark, con, name: str, sf_dir: str) -> str:
    """'' when equal, otherwise what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    rel = con.sql(entry.oracle_sql()[name])
    want = rel.fetchall()
    types = {c: KINDS.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    problems = []
    if types != dict(df.dtypes):
        problems.append(f"schema {sorted(set(types.items()) ^ set(df.dtypes))}")
    if not got:
        problems.append("no rows")
    a, b = _rows(df.columns, got), _rows(rel.columns, want)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        extra, lacking = set(a) - set(b), set(b) - set(a)
        problems.append(f"values: only Spark {sorted(extra)[:2]}, only SQL {sorted(lacking)[:2]}")
    return "; ".join(problems)


def main() -> None:
    from threadlake.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(entry.queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf_dir)
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as e:  # shown, so that the other queries still run
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{name:22s} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)


if __name__ == "__main__":
    main()
