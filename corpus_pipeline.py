"""A cleaning pipeline over documents: each stage's rows are written and read again as the next one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decon, langid, linededup, simhash
from lodestone.llm.common import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in the script of any learned language go."""
    return langid.keep_known(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more leave the texts; n_chars follows."""
    found = linededup.dedup(docs, linededup.MIN_WORDS, report=False)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints stays."""
    return simhash.keep_one(docs, bits=3, shingle=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a ten-word window of a benchmark item occurs go."""
    return decon.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return bpe.encode(docs, digests=True)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("bpe encoding", encode),
]

#: Fingerprints' components and BPE have no SQL here; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return docs
