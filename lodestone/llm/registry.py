"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and ORACLE_SQL.
MODULES = ("q_bpe", "q_ann", "q_decon", "q_linededup", "q_sst", "q_simhash", "q_warc", "q_chat", "q_langid", "q_hmm", "q_pipeline")


def queries() -> dict:
    out = {}
    for m in MODULES:
        out |= import_module(f"lodestone.llm.{m}").QUERIES
    return out


def oracle_sql() -> dict:
    out = {}
    for m in MODULES:
        out |= import_module(f"lodestone.llm.{m}").ORACLE_SQL
    return out
