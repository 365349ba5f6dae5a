"""Compare queries with their SQL checks; also a command line: ``oracle.py SF_DIR [name …]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from webweave.catalog import ORACLES, QUERIES  # noqa: E402
from webweave.fixtures import BASE_TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(x: object) -> str:
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "∅"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if isinstance(x, pd.Timestamp):
        return x.isoformat()
    if isinstance(x, (int, float)) or hasattr(x, "dtype"):
        return f"{float(x):.6f}"
    if isinstance(x, (bytes, bytearray)):
        return x.hex()
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    frame = frame.astype(object)
    return sorted(tuple(_value(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    ours, theirs = rows(spark_frame), rows(sql_frame)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{sorted(spark_frame.columns)}\n   spark {str(a)[:600]}\n   sql   {str(b)[:600]}"
    return None


if __name__ == "__main__":
    from webweave.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sys.argv[1])
    for name in sys.argv[2:] or QUERIES:
        try:
            start = time.time()
            ours = QUERIES[name](spark, sys.argv[1]).toPandas()
            middle = time.time()
            verdict = "rows only"
            if name in ORACLES:
                sql_frame = con.execute(ORACLES[name]).df()
                verdict = difference(ours, sql_frame) or "equal"
            print(f"{name}: {len(ours)} rows, spark {middle - start:.1f}s, sql {time.time() - middle:.1f}s: {verdict}", flush=True)
        except Exception as problem:
            print(f"{name}: FAILED {type(problem).__name__} {str(problem)[:700]}", flush=True)
