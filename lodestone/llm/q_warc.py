"""op7: every page written to monolithic archives, normalised, and read back."""

from __future__ import annotations

from lodestone.llm import warc
from lodestone.llm.common import Scratch, read


def op7_warc_normaliser(spark, sf_dir):
    scratch = Scratch(spark, "warc")
    monolithic = warc.write(read(spark, sf_dir, "pages"), scratch.folder("crawl"), scratch)
    return warc.read(warc.normalise(monolithic, scratch.folder("archive"), scratch))


QUERIES = {"op7_warc_normaliser": op7_warc_normaliser}
ORACLE_SQL = {
    "op7_warc_normaliser": """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last_id FROM p)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> last_id THEN last_id END AS refers_to
    FROM r"""
}
