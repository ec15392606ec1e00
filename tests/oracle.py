"""Compares a query with its SQL as the driver does: columns sorted by name, rows in any order."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

DATA = os.environ.get("GRIDSKEIN_DATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(frame):
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False, name=None):
        rows.append(tuple(None if v is None or v is pd.NA or v != v else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v) for v in row))
    return sorted(rows, key=repr)


def compare(con, frame, sql: str) -> str:
    """Empty if the query's frame equals the SQL's result, else what differs."""
    want = con.execute(sql).df()
    if sorted(frame.columns) != sorted(want.columns):
        return f"columns {sorted(frame.columns)} and {sorted(want.columns)}"
    a, b = _plain(frame), _plain(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    off = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(off)} of {len(a)} rows differ, e.g. {off[0]}" if off else ""


if __name__ == "__main__":  # python -m tests.oracle [prefix...]
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = f"{DATA}/{os.environ.get('SF', 'sf0.01')}"
    con, bad = connect(sf), 0
    for name, query in entry.queries().items():
        if sys.argv[1:] and not name.startswith(tuple(sys.argv[1:])):
            continue
        began = time.time()
        try:
            frame = query(spark, sf).toPandas()
            said = compare(con, frame, entry.oracle_sql()[name]) if name in entry.oracle_sql() else "no SQL"
        except Exception as error:  # noqa: BLE001
            said = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(said) and said != "no SQL"
        print(f"{name}: {said or 'ok'} ({len(frame)} rows, {time.time() - began:.1f} s)", flush=True)
    print("bad:", bad)
