"""Order-insensitive comparison of a Spark query with its SQL on the same tables."""

import glob
import math
import os

import duckdb

SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
               "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> list[str]:
    found = []
    spark_rows = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    types = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    for name, kind in df.dtypes:
        if SPARK_TYPES.get(kind, kind) != types[name]:
            found.append(f"type of {name}: {kind} != {types[name]}")
    if len(spark_rows) != len(rows):
        found.append(f"rows {len(spark_rows)} != {len(rows)}")
    left, right = _rows(df.columns, spark_rows), _rows(names, rows)
    if left != right:
        extra = [r for r in left if r not in set(right)][:3] if len(left) < 200_000 else []
        missing = [r for r in right if r not in set(left)][:3] if len(left) < 200_000 else []
        found.append(f"values differ over {sorted(names)}: only spark {extra}, only sql {missing}")
    return found
