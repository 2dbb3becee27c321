"""op10: every document's log probability under the unigram base and the hidden Markov model."""

from __future__ import annotations

from lodestone.llm import hmm
from lodestone.llm.common import read


def op10_hmm_score(spark, sf_dir):
    found = hmm.score(read(spark, sf_dir, "documents"), folds=10)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op10_hmm_score": op10_hmm_score}
ORACLE_SQL = {}
