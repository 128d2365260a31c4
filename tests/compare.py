"""python tests/compare.py SF_DIR [NAME...]: runs queries and their SQL side by side; prints what differs."""

import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return [columns[i] for i in order], sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


def compared(spark, con, name, query, sql, sf_dir):
    """An empty string, or how they differ."""
    df = query(spark, sf_dir)
    left = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    right = rows_of(rel.columns, rel.fetchall())
    if left == right:
        return ""
    if left[0] != right[0] or len(left[1]) != len(right[1]):
        return f"columns {left[0]} {right[0]}, rows {len(left[1])} {len(right[1])} {left[1][:2]} {right[1][:2]}"
    bad = [(a, b) for a, b in zip(left[1], right[1], strict=True) if a != b]
    return f"{len(bad)} of {len(left[1])} rows, as {bad[:3]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"{tempfile.mkdtemp()}/ckpt").config("spark.sql.warehouse.dir", f"{tempfile.mkdtemp()}/wh").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = views(sf_dir), e.queries(), e.oracle_sql()
    for name in names or [n for n in queries if not n.startswith("op") and n != "pipeline"]:
        t = time.time()
        try:
            if name in sql:
                said = compared(spark, con, name, queries[name], sql[name], sf_dir) or "same"
            else:
                said = f"{len(queries[name](spark, sf_dir).collect())} rows, no SQL"
        except Exception as error:
            said = f"FAILED {type(error).__name__} {str(error)[:400]}"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
