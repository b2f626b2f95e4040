"""Scalar functions as expressions over the tables."""

from .catalog import q

q("fn_collapse_ws", "SELECT block_id, trim(regexp_replace(text, $R'[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+', ' '$G)) AS collapsed FROM truth WHERE text IS NOT NULL")
q("fn_furniture_template", "SELECT block_id, regexp_replace(trim(regexp_replace(text, $R'\\s+', ' '$G)), '[0-9]+', '#'$G) AS template FROM lines WHERE text IS NOT NULL")
q("fn_join_paragraph", "SELECT block_id, CASE WHEN nxt IS NULL THEN text WHEN $LIKE(text, '-$') THEN substr(text, 1, length(text) - 1) || nxt ELSE text || ' ' || nxt END AS joined FROM (SELECT block_id, text, lead(text) OVER (PARTITION BY document_id, page_index ORDER BY y DESC, x, block_id) AS nxt FROM lines WHERE text IS NOT NULL) t")
q("fn_toc_spoken", "SELECT doc_id, regexp_replace('Title ' || cast(doc_id AS $STR) || ' .... ' || cast(n_chars AS $STR), $R'\\s*\\.{3,}\\s*[0-9]+', ''$G) AS spoken FROM documents")
q("fn_leading_callout", "SELECT block_id, regexp_extract(text, $R'^([0-9]{1,3})\\s', 1) AS numeral FROM truth WHERE text IS NOT NULL")
q("fn_frontend_voice", "SELECT doc_id, CASE lower(lang) WHEN 'es' THEN 'es' WHEN 'en' THEN 'en-us' WHEN 'pt' THEN 'pt-br' END AS voice FROM documents")
q("fn_espeak_stdin", "SELECT unit_id, $SHA(text || chr(10)$256) AS digest FROM units WHERE text IS NOT NULL")
PJ = "SELECT unit_id, regexp_replace(text, ' ([,.;:!?—])', {ref}$G) AS joined FROM units WHERE text IS NOT NULL"
q("fn_punct_join", PJ.format(ref="'$1'"), PJ.format(ref=r"'\1'"))
q("fn_document_id", "SELECT document_id, substr($SHA(document_id$256), 1, 32) AS document_key, substr($SHA(document_id$256), 1, 16) AS cli_key, 'generation_' || substr($SHA(document_id$256), 1, 16) AS generation_id FROM entries")
q("fn_carries_no_reading", "SELECT doc_id, $LIKE(text, $R'[\\x{FFFD}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}\\x{E000}-\\x{F8FF}]') AS unreadable FROM documents WHERE text IS NOT NULL")
q("fn_sqdist", "SELECT id, (x + w / 2.0 - 300) * (x + w / 2.0 - 300) + (y + h / 2.0 - 400) * (y + h / 2.0 - 400) AS sqdist FROM rects")
q("fn_sigmoid", "SELECT s_suppkey, round(1 / (1 + exp(-greatest(-80.0, least(80.0, s_acctbal / 1000.0)))), 9) AS sigmoid FROM supplier")
q("fn_ocr_scale", "SELECT id, round(least(300.0 / 72, 3200.0 / greatest(w, h), sqrt(24000000.0 / (w * h))), 9) AS scale FROM rects")
q("fn_self_hash", "SELECT document_id, $SHA(regexp_replace('{' || document_id || ':' || coalesce(sha256_hex, '') || '}', '[0-9a-f]{64}', '0'$G)$256) AS hash FROM entries")
q("fn_parse_case", "SELECT doc_id, $PART(line, ':', 1) AS kind, cast($PART(line, ':', 2) AS int) AS pages, $PART(line, ':', 3) AS route FROM (SELECT doc_id, genre || ':' || cast(n_chars AS $STR) || ':' || source AS line FROM documents) t")
q("fn_reading_progress", "SELECT document_id, page_index, round(least(1.0, greatest(0.0, page_index * 1.0 / greatest(1, max(page_index) OVER (PARTITION BY document_id)))), 9) AS progress FROM candidates")
q("fn_error_map", "SELECT c.request_id, m.code, m.message_key FROM candidates c JOIN (SELECT * FROM (VALUES ('ocr_unavailable', 'OCR_UNAVAILABLE', 'error.ocr'), ('ocr_timeout', 'OCR_TIMEOUT', 'error.timeout'), ('raster_failed', 'RASTER_FAILED', 'error.raster')) AS v(internal, code, message_key)) m ON c.ocr_error_code = m.internal")
q("fn_resolve_localization", "SELECT document_id, coalesce(CASE WHEN lower(substr(trim(language), 1, 2)) IN ('es', 'en', 'pt') THEN lower(substr(trim(language), 1, 2)) END, 'en') AS locale FROM entries")
JH = "SELECT block_id, regexp_replace(regexp_replace(text, chr(13) || chr(10), chr(10)$G), $R'([A-Za-zÀ-ÿ])-\\n([A-Za-zÀ-ÿ])', {ref}$G) AS joined FROM truth WHERE degradation = 'scanned' AND text IS NOT NULL"
q("fn_join_line_end_hyphen", JH.format(ref="'$1$2'"), JH.format(ref=r"'\1\2'"))
q("fn_parse_model_json", "SELECT event_id, cast(get_json_object(substr(props, instr(props, '{')), '$.k') AS int) AS k FROM events", "SELECT event_id, cast(json_extract_string(substr(props, instr(props, '{')), '$.k') AS int) AS k FROM events")
