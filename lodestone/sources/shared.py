"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or else set for checkpoints; one of our own only in local mode, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not now.isEmpty():
        return str(now.get()).rstrip("/").rsplit("/", 1)[0]  # Spark adds a folder for each session
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/checkpoints"


def at(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def put(df: DataFrame, path: str, **options) -> None:
    """Writes the rows as parquet, added to those there. The shuffle files behind them go at once: the table is what is read from now on."""
    conf = df.sparkSession.conf
    was = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode("append").options(**options).parquet(path)
    finally:
        conf.set(_CLEANUP, was)


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: it outlives the executors that made it, and is computed once."""
    path = f"{shared_dir(df.sparkSession)}/lodestone-cut-{uuid.uuid4().hex}"
    put(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote."""
    for df in tables:
        fs, where = at(df.sparkSession, df._cut_path)
        fs.delete(where, True)


def sweep(spark: SparkSession) -> int:
    """Deletes every table that cut() left in the shared folder, once no result is read any more; their number."""
    fs, where = at(spark, f"{shared_dir(spark)}/lodestone-cut-*")
    found = list(fs.globStatus(where) or [])
    for f in found:
        fs.delete(f.getPath(), True)
    return len(found)
