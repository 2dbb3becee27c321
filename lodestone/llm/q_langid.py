"""op9: the language of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.llm import langid
from lodestone.llm.common import read


def op9_langid_viterbi(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs, folds=5))
    return found.select("doc_id", langid.held_out(found).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_langid_viterbi": op9_langid_viterbi}
ORACLE_SQL = {}
