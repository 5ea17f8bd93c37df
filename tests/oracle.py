"""Comparing a Spark result with DuckDB's over the same tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return list(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def differences(spark_df, con, sql: str) -> str:
    """Empty if column names and all rows agree."""
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    want, have = rows_of(names, got.fetchall()), rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if want == have:
        return ""
    only = [x for x in have if x not in set(want)][:3], [x for x in want if x not in set(have)][:3]
    return f"{len(have)} rows against {len(want)}; only here {only[0]}, only there {only[1]}"
