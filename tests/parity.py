"""Spark result vs DuckDB oracle: row count, column names/types, values.

Mirrors what the driver checks: columns compared by sorted name, rows
compared as an order-insensitive multiset.  Doubles are compared after
rounding to 6 decimals.
"""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

SPARK_TO_DUCK = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "float": "FLOAT",
    "smallint": "SMALLINT",
    "tinyint": "TINYINT",
    "date": "DATE",
}


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf: pd.DataFrame, cols: list[str]) -> list[tuple]:
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    rows = [tuple(_norm(v) for v in r) for r in pdf.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark_df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> dict:
    s_types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    s_pdf = spark_df.toPandas()
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_pdf = pd.DataFrame(rel.fetchall(), columns=d_cols)
    d_types = {
        r[0]: r[1]
        for r in con.execute(f"DESCRIBE ({sql})").fetchall()
    }
    out = {"rows_spark": len(s_pdf), "rows_oracle": len(d_pdf)}
    out["names_match"] = sorted(s_types) == sorted(d_types)
    if not out["names_match"]:
        out["names"] = (sorted(s_types), sorted(d_types))
        out["ok"] = False
        return out
    type_diff = {
        c: (s_types[c], d_types[c])
        for c in s_types
        if SPARK_TO_DUCK.get(s_types[c], s_types[c].upper()) != d_types[c]
    }
    out["type_diff"] = type_diff
    cols = sorted(s_types)
    s_rows = _rows(s_pdf, cols)
    d_rows = _rows(d_pdf, cols)
    out["values_match"] = s_rows == d_rows
    if not out["values_match"]:
        s_set, d_set = set(s_rows), set(d_rows)
        out["only_spark"] = list(s_set - d_set)[:5]
        out["only_oracle"] = list(d_set - s_set)[:5]
    out["ok"] = out["values_match"] and not type_diff and len(s_pdf) == len(d_pdf)
    return out
