"""Join-shaped computations and set operations."""

from .catalog import q

q("join_artifact_anti", "WITH e AS (SELECT DISTINCT document_id FROM entries), o AS (SELECT DISTINCT document_id FROM lines) SELECT document_id, 'missing' AS problem FROM e WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.document_id = e.document_id) UNION ALL SELECT document_id, 'unexpected' FROM o WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.document_id = o.document_id)")
q("join_segments_units", "SELECT o.o_orderkey AS unit_id, count(s.segment_index) AS segments, coalesce(max(s.segment_index) + 1 = count(s.segment_index), false) AS contiguous FROM orders o LEFT JOIN segments s ON s.unit_id = o.o_orderkey GROUP BY o.o_orderkey")
q("join_anchor_units", "SELECT u.unit_id, u.anchor_id, b.block_id FROM units u JOIN (SELECT document_id, min(block_id) AS block_id FROM paragraphs GROUP BY document_id) b ON u.document_id = b.document_id WHERE u.anchor_id IS NOT NULL")
q("join_credits_dedupe", "SELECT document_id, language, present FROM (SELECT m.document_id, m.language, m.sha256_hex IS NOT NULL AS present, row_number() OVER (PARTITION BY m.document_id ORDER BY m.received_at, m.byte_size) AS rk FROM manifest m) t WHERE rk = 1")
q("join_manifest_role", "SELECT document_id, file_path FROM entries WHERE entry_role = 'long_form'")
# set operations
q("set_ocr_pages", "SELECT document_id, page_index FROM candidates WHERE raster UNION SELECT document_id, page_index FROM truth WHERE degradation = 'scanned'")
q("set_equal_matrix", "WITH a AS (SELECT DISTINCT layout, content FROM entries), b AS (SELECT * FROM (VALUES ('single_column', 'digital'), ('single_column', 'scanned'), ('single_column', 'mixed'), ('multi_column', 'digital'), ('multi_column', 'scanned'), ('multi_column', 'mixed')) AS v(layout, content)) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x) = 0 AND (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) y) = 0 AS equal")
q("set_case_ids", "SELECT (SELECT count(*) FROM (SELECT document_id FROM truth EXCEPT SELECT document_id FROM entries) x) AS unknown_documents, (SELECT count(DISTINCT document_id) FROM truth) AS documents")
