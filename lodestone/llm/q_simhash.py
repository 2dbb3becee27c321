"""op6: fingerprint and component of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.llm import simhash
from lodestone.llm.common import read


def op6_simhash_trie(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), bits=3, shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash_trie": op6_simhash_trie}
ORACLE_SQL = {}
