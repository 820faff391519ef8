"""Runs registered queries against their SQL in DuckDB: `python tests/compare.py [names...]`."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from veilframe.registry.base import TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return "\0null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else format(round(value, 6) + 0.0, ".6f")
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def compare(spark, con, query, folder: str) -> str | None:
    """None when rows agree, else what differs."""
    df = query.run(spark, folder)
    names = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect())
    if query.sql is None:
        return None
    cur = con.execute(query.sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}"
    order = [columns.index(n) for n in names]
    want = sorted(tuple(plain(row[i]) for i in order) for row in cur.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; first {got[:2]} against {want[:2]}"
    for g, w in zip(got, want, strict=True):
        if g != w:
            return f"{names}\n   spark  {[x[:150] for x in g]}\n   duckdb {[x[:150] for x in w]}"
    types = {n: t for n, t in df.dtypes}
    sql_types = dict(zip(columns, [str(d[1]) for d in cur.description], strict=True))
    pairs = {n: (types[n], sql_types[n]) for n in names if not same_type(types[n], sql_types[n])}
    return f"types {pairs}" if pairs else None


_SAME = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT",
    "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP", "binary": "BLOB",
}


def same_type(spark_type: str, sql_type: str) -> bool:
    if spark_type.startswith("array<"):
        return sql_type.endswith("[]") and same_type(spark_type[6:-1], sql_type[:-2])
    return _SAME.get(spark_type, spark_type.upper()) == sql_type.upper()


if __name__ == "__main__":
    from veilframe.registry import QUERIES
    from veilframe.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    session = build_session(master="local[8]", **{"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8"})
    session.sparkContext.setLogLevel("ERROR")
    db, bad = connect(sf), 0
    for name in sys.argv[1:] or QUERIES:
        start = time.time()
        try:
            problem = compare(session, db, QUERIES[name], sf)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        mark = "ok" if QUERIES[name].sql else "rows only"
        print(f"{'BAD' if problem else mark:9} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} bad of {len(sys.argv[1:] or QUERIES)}")
