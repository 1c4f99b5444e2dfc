"""Run named queries on Spark and as plain SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def spark_rows(df):
    return normalise(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cursor = con.execute(sql)
    return normalise([d[0] for d in cursor.description], cursor.fetchall())


def difference(spark_side, duck_side) -> str | None:
    (sc, sr), (dc, dr) = spark_side, duck_side
    if sc != dc:
        return f"columns differ: {sc} / {dc}"
    if len(sr) != len(dr):
        extra = [r for r in sr if r not in set(dr)][:2], [r for r in dr if r not in set(sr)][:2]
        return f"{len(sr)} rows / {len(dr)} rows; {extra}"
    for a, b in zip(sr, dr):
        if a != b or [type(v) for v in a] != [type(v) for v in b]:
            return f"{sc}\n   spark {a}\n   duck  {b}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from secstream.session import local_session

    sf_dir = f"/root/testdata/{os.environ.get('SF', 'sf0.01')}"
    wanted = sys.argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = oracle_sql()
    failed = []
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            got = spark_rows(run(spark, sf_dir))
            took = time.time() - began
            began = time.time()
            problem = difference(got, duck_rows(con, sql[name])) if name in sql else None
            note = "" if name in sql else " (rows only)"
            print(f"{'FAIL' if problem else 'ok  '} {name}{note} rows={len(got[1])} spark={took:.1f}s duck={time.time() - began:.1f}s", flush=True)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
            print(f"FAIL {name}", flush=True)
        if problem:
            failed.append(name)
            print("   ", problem[:1200], flush=True)
    print("failed:", failed)
