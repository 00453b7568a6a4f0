"""Results of a query and of its SQL as sorted rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return str(value) if value is not None and not isinstance(value, (int, float, str, bool)) else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def sql_rows(sql, where=DATA):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    return sorted(names), rows(names, found.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])
