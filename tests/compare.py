"""A query's rows against those of its SQL in DuckDB. As a script: python tests/compare.py FOLDER [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return db


def differences(spark, db, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same rows, else what differs."""
    frame = query(spark, sf_dir)
    own = [tuple(r) for r in frame.collect()]
    done = db.execute(sql)
    columns = [d[0] for d in done.description]
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(columns)}"
    a, b = _rows(frame.columns, own), _rows(columns, done.fetchall())
    if a == b:
        return ""
    odd = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return f"rows {len(a)} and {len(b)}, first differences {odd}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder, wanted = sys.argv[1], sys.argv[2:]
    queries, sql, db = entry.queries(), entry.oracle_sql(), duck(sys.argv[1])
    for name in wanted or [n for n in queries if not n.startswith("op") and n != "pipeline"]:
        began = time.time()
        try:
            said = differences(spark, db, folder, queries[name], sql[name]) if name in sql else f"no SQL, {queries[name](spark, folder).count()} rows"
        except Exception as error:
            said = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28} {time.time() - began:6.1f} s  {said or 'equal'}", flush=True)
