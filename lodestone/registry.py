"""Every registered query of the graph engine and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.catalog import graph, logs, project, store

QUERIES = {**graph.QUERIES, **logs.QUERIES, **store.QUERIES, **project.QUERIES}
ORACLE_SQL = {**graph.ORACLE_SQL, **logs.ORACLE_SQL, **store.ORACLE_SQL, **project.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["callers"](spark, sf_dir)
