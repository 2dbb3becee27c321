"""op2: the five nearest of every fiftieth vector among all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.llm import ann
from lodestone.llm.common import read


def op2_ann_multiprobe(spark, sf_dir):
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES = {"op2_ann_multiprobe": op2_ann_multiprobe}
ORACLE_SQL = {}
