"""op4: every document's text without later copies of line runs of 50 words or more."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.llm import linededup
from lodestone.llm.common import read


def op4_line_dedup(spark, sf_dir):
    found = linededup.dedup(read(spark, sf_dir, "documents"), linededup.MIN_WORDS)
    return found.select("doc_id", "text", F.col("ld_lines").alias("n_lines"), F.col("ld_removed").alias("n_removed"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE_SQL = {
    "op4_line_dedup": r"""
    WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
    w AS (SELECT doc_id, i, l[i] AS line, len(regexp_extract_all(l[i], '\S+')) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
    c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS c, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS e FROM w),
    r AS (SELECT a.doc_id, a.i, min(b.i) AS j FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.i >= a.i AND b.c - a.e >= 50 GROUP BY ALL
          UNION SELECT b.doc_id, max(a.i) AS i, b.i AS j FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.i >= a.i AND b.c - a.e >= 50 GROUP BY b.doc_id, b.i),
    k AS (SELECT r.doc_id, i, j, j - i + 1 AS m, sha256(array_to_string(list_slice(l, i, j), chr(10))) AS k FROM r JOIN d USING (doc_id)),
    o AS (SELECT *, min((doc_id, i)) OVER (PARTITION BY m, k) AS f FROM k),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM o WHERE NOT (f[1] = doc_id AND i - f[2] < m)),
    kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
    SELECT d.doc_id, coalesce(kept.text, '') AS text, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
    FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""
}
