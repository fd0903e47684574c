"""Hold every query against its SQL: python tests/compare.py FOLDER [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda v: None if v is None else f"{v:.6g}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if the results are equal; otherwise what differs."""
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, found.fetchall())
    if ours == theirs:
        return "" if ours else "no rows"
    a, b = [r for r in ours if r not in set(theirs)], [r for r in theirs if r not in set(ours)]
    return f"{len(ours)} and {len(theirs)} rows; only here {a[:2]}; only there {b[:2]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tests.conftest import session

    spark, con = session(), database(sys.argv[1])
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            said = difference(queries[name](spark, sys.argv[1]), con, oracle[name]) if name in oracle else f"rows only: {len(queries[name](spark, sys.argv[1]).collect())}"
        except Exception as e:  # noqa: BLE001
            said = "ERROR " + str(e)[:600]
        spark.catalog.clearCache()
        print(f"{name:22} {time.time() - t:5.1f} s  {said or 'equal'}", flush=True)
