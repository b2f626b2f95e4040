"""Scans, sources and sinks that SQL can state over the tables; file formats are in ``quireflow.sources``."""

from .catalog import q

q("src_payload_validate_page", "SELECT document_id, page_index, count(*) <= 10000 AND bool_and(length(block_id) BETWEEN 1 AND 128) AND count(DISTINCT block_id) = count(*) AS valid FROM lines GROUP BY document_id, page_index")
q("src_open_document_validate", "SELECT document_id, count(*) <= 64 OR max(page_index) < 100000 AS priming_ok, bool_and(page_index >= 0) AS pages_ok FROM candidates GROUP BY document_id")
q("src_page_limit", "SELECT block_id, page_index FROM truth WHERE page_index < 5")
q("src_ocr_half_fallback", "SELECT request_id, CASE WHEN n_ocr > 0 THEN n_ocr ELSE n_direct END AS blocks, n_ocr = 0 AND n_direct = 0 AS unresolved FROM candidates")
q("src_raster_probe", "SELECT request_id, raster AND n_direct = 0 AS raster_outside_text FROM candidates")
q("src_pdf_outline", "WITH RECURSIVE outline AS (SELECT r_regionkey AS node, cast(r_name AS $STR) AS label, 0 AS level FROM region UNION ALL SELECT n.n_nationkey + 100, cast(n.n_name AS $STR), o.level + 1 FROM outline o JOIN nation n ON n.n_regionkey = o.node AND o.level = 0) SELECT label, level FROM outline")
q("src_fingerprint", "SELECT doc_id, $SHA(text$256) AS fingerprint FROM documents WHERE text IS NOT NULL")
q("src_ps_table", "SELECT event_id, cast($PART(line, ' ', 1) AS bigint) AS pid, cast($PART(line, ' ', 2) AS bigint) AS rss, $PART(line, ' ', 3) AS command FROM (SELECT event_id, cast(user_id AS $STR) || ' ' || cast(event_id * 4 AS $STR) || ' ' || event_type AS line FROM events) t")
q("snk_state_usage_delete", "SELECT entry_role, cast(sum(byte_size) AS bigint) AS used_bytes FROM entries GROUP BY entry_role")
