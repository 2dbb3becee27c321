"""op1: digests of the ids and of the decoded text of every document."""

from __future__ import annotations

from lodestone.llm import bpe
from lodestone.llm.common import read


def op1_bpe_chunk_reuse(spark, sf_dir):
    return bpe.encode(read(spark, sf_dir, "documents"), digests=True)


QUERIES = {"op1_bpe_chunk_reuse": op1_bpe_chunk_reuse}
ORACLE_SQL = {}
