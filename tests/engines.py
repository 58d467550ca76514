"""Running a query on both engines and comparing the rows."""

import datetime as dt
import decimal
import os
from collections import Counter

import duckdb

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def open_duckdb(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return value.normalize() + 0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def row_counts(columns, rows):
    """Multiset of the rows, with the columns in order of name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


KINDS = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date",
         "TIMESTAMP": "timestamp_ntz", "DOUBLE": "double"}


def duck_kind(kind):
    kind = str(kind)
    if kind.startswith("DECIMAL"):
        return "decimal" + kind[kind.index(","):-1]
    return KINDS.get(kind, kind)


def spark_kind(kind):
    return "decimal" + kind[kind.index(","):-1] if kind.startswith("decimal") else kind
