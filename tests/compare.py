"""Runs registered queries beside their SQL in DuckDB. python -m tests.compare SF_DIR [name...]"""

from __future__ import annotations

import math
import sys
import time


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def differs(spark, duck, f, sql, sf_dir):
    """None, or how the two results differ."""
    df = f(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in names) for r in df.collect()), key=str)
    rel = duck.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} against {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in names]
    want = sorted((tuple(normal(r[i]) for i in at) for r in rel.fetchall()), key=str)
    if got != want:
        bad = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
        return f"{len(got)} rows against {len(want)}; {bad}"
    return None if got else "no rows"


def connect(sf_dir):
    import duckdb

    duck = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return duck


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.checkpoint.dir", "/tmp/checkpoints").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    duck, queries, sqls = connect(sf_dir), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            if name in sqls:
                said = differs(spark, duck, queries[name], sqls[name], sf_dir) or "same"
            else:
                said = f"no SQL, {queries[name](spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
