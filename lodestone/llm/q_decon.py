"""op3: hits of the benchmark's ten-word windows in every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.llm import decon
from lodestone.llm.common import read


def op3_decontamination(spark, sf_dir):
    found = decon.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
QUERIES = {"op3_decontamination": op3_decontamination}
ORACLE_SQL = {
    "op3_decontamination": f"""
    WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
    b AS (SELECT item_id, w, least(10, len(w)) AS s FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, s, array_to_string(list_slice(w, i, i + s - 1), ' ') AS k
           FROM (SELECT item_id, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM b)),
    sizes AS (SELECT DISTINCT s FROM bw),
    dw AS (SELECT doc_id, s, i, array_to_string(list_slice(w, i, i + s - 1), ' ') AS k
           FROM (SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM d, sizes WHERE len(w) >= s)),
    found AS (SELECT doc_id, item_id, i, s FROM dw JOIN bw USING (s, k)),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + s)) AS p FROM (SELECT DISTINCT doc_id, i, s FROM found)) GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id"""
}
