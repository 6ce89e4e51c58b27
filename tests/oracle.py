"""Compares the queries with their SQL: python -m tests.oracle FOLDER [NAME...]"""

import math
import sys
import time
from pathlib import Path

import duckdb


def connect(folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, query, sql):
    """None, or what differs."""
    df = query(spark, folder)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, cur.fetchall())
    if a != b:
        first = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return f"{len(a)} and {len(b)} rows, first difference {first}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder, con, sql = sys.argv[1], connect(sys.argv[1]), entry.oracle_sql()
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:] or len(sys.argv) == 2 and name[:2] == "op" and name[2].isdigit():
            continue
        began = time.time()
        try:
            said = compare(spark, con, folder, query, sql[name]) if name in sql else f"no SQL; {query(spark, folder).count()} rows"
        except Exception as e:
            said = f"{type(e).__name__} {str(e)[:600]}"
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
