"""Oracles of the retrieval queries."""

from __future__ import annotations

from fairlead.bindings import with_views
from fairlead.oracle.ranking import dot
from fairlead.plans.registry import oracle

CHUNKS = """, tx AS (SELECT listing_id, url, array_to_string(['Title: ' || coalesce(title, ''), 'Institution: ' || coalesce(institution, 'Unknown'), 'Program: N/A', 'Summary: ' || coalesce(summary, ''),
 'Requirements: ' || array_to_string(requirements, ', '), 'Tags: ' || array_to_string(tags, ', ')], chr(10)) AS t FROM listings),
st AS (SELECT *, unnest(CASE WHEN length(t) <= 800 THEN [0] ELSE generate_series(0, length(t) - 1, 700) END) AS s FROM tx),
ch AS (SELECT listing_id, s // 700 AS chunk_index, CASE WHEN length(t) <= 800 THEN t ELSE substr(t, s + 1, 800) END AS content, url AS source_url FROM st)"""
TOP = CHUNKS + f""", cv AS (SELECT ch.*, v.embedding AS vec FROM ch LEFT JOIN vectors v ON v.vec_id = (ch.listing_id * 31 + ch.chunk_index) % (SELECT count(*) FROM vectors) AND v.vec_id % 4 <> 3),
qs AS (SELECT user_id * 1000000 + f.listing_id AS query_id, f.listing_id, v.embedding AS qv FROM feedback f LEFT JOIN vectors v ON v.vec_id = f.user_id WHERE f.status = 'applied'),
sc AS (SELECT query_id, chunk_index, content, source_url, round(CASE WHEN qv IS NULL OR vec IS NULL THEN 0.0::DOUBLE ELSE {dot('qv', 'vec')} / (sqrt({dot('qv', 'qv')}) * sqrt({dot('vec', 'vec')})) END, 6) AS score FROM qs JOIN cv USING (listing_id)),
tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index) AS place FROM sc)"""


def aq(name: str, sql: str, views: str = "listings") -> None:
    oracle(name, with_views(views, sql))


aq("a01_index_listings", CHUNKS + """ SELECT listing_id, CAST(chunk_index AS BIGINT) AS chunk_index, md5(content) AS content_md5, source_url FROM ch
 WHERE listing_id % 3 = 0 OR listing_id % 4 = 0 OR chunk_index > 100""")
aq("a02_retrieve_topk", TOP + " SELECT query_id, CAST(chunk_index AS BIGINT) AS chunk_index, place, round(score + 1e-9, 4) AS score FROM tp WHERE place <= 5", "listings feedback vectors")
aq("a02_retrieval_context", TOP + """ SELECT query_id, md5(string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place)) AS context_md5,
 string_agg(DISTINCT source_url, '|' ORDER BY source_url) AS citations FROM tp WHERE place <= 3 GROUP BY query_id""", "listings feedback vectors")
aq("a03_unindexed_listings", "SELECT listing_id FROM listings WHERE listing_id % 4 = 0")
aq("a04_mentioned_connections", """, x AS (SELECT listing_id, lower(concat_ws(' ', title, summary)) AS t FROM listings)
SELECT listing_id, array_to_string(list_filter([CASE WHEN contains(t, 'scholarship') THEN 'Your project ''Scholarship'' is mentioned in related context' END, CASE WHEN contains(t, 'zebra') THEN 'Your project ''Zebra'' is mentioned in related context' END,
 CASE WHEN contains(t, 'beta') THEN 'Connection ''beta'' appears relevant' END, CASE WHEN contains(t, 'tuition') THEN 'Connection ''Tuition'' appears relevant' END, CASE WHEN contains(t, 'nobody') THEN 'Connection ''nobody'' appears relevant' END], lambda z: z IS NOT NULL), '|') AS lines FROM x""")
aq("a05_embed_column", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(substr(text, 1, 8000)), '[a-z0-9]+')) AS w FROM documents),
c AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 6) AS INT) % 16 AS slot, count(*) AS n FROM w GROUP BY ALL), g AS (SELECT doc_id, unnest(generate_series(0, 15)) AS slot FROM documents WHERE trim(text) <> '')
SELECT doc_id, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY g.slot) AS vec FROM g LEFT JOIN c USING (doc_id, slot) GROUP BY doc_id""", "")
