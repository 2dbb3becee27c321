"""op5: ids written as sorted-string-table shards and read back."""

from __future__ import annotations

from lodestone.llm import sst
from lodestone.llm.common import Scratch, read


def op5_sst_shards(spark, sf_dir):
    scratch = Scratch(spark, "sst")
    manifest = sst.write(read(spark, sf_dir, "documents"), scratch.folder("shards"), scratch)
    return sst.read_back(manifest, digests=True)


QUERIES = {"op5_sst_shards": op5_sst_shards}
ORACLE_SQL = {}
