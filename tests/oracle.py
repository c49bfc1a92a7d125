"""A query's rows against those of its SQL in DuckDB: columns by name, rows in any order."""

import glob
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return float(f"{float(x):.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    if hasattr(x, "isoformat"):
        return x.isoformat()[:26]
    return str(x)


def compare(spark_rows, columns, con, sql):
    """None if equal, else what differs."""
    out = con.sql(sql)
    if sorted(columns) != sorted(out.columns):
        return f"columns {sorted(columns)} and {sorted(out.columns)}"
    order = sorted(columns)
    theirs = Counter(tuple(_plain(r[out.columns.index(c)]) for c in order) for r in out.fetchall())
    ours = Counter(tuple(_plain(r[c]) for c in order) for r in spark_rows)
    if ours != theirs:
        return f"{order}: {sum(ours.values())} and {sum(theirs.values())} rows; only here {list((ours - theirs).items())[:3]}, only there {list((theirs - ours).items())[:3]}"
    return None
