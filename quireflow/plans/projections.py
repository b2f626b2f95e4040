"""Projections, filters and predicates over the line and unit tables."""

from .catalog import q

ROT = "((abs(page_index) % 4) * 90)"
q("prj_reading_rect", f"SELECT block_id, {ROT} AS rotation, CASE {ROT} WHEN 90 THEN y WHEN 180 THEN -(x + w) WHEN 270 THEN -(y + h) ELSE x END AS rx, CASE {ROT} WHEN 90 THEN -(x + w) WHEN 180 THEN -(y + h) WHEN 270 THEN x ELSE y END AS ry, CASE WHEN {ROT} IN (90, 270) THEN h ELSE w END AS rw, CASE WHEN {ROT} IN (90, 270) THEN w ELSE h END AS rh FROM lines")
RELIABLE = "(x IS NOT NULL AND y IS NOT NULL AND w > 0 AND h > 0 AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(w) AND NOT isnan(h) AND coalesce(confidence, 0) >= 0.6)"
q("prd_region_reliable", f"SELECT block_id, {RELIABLE} AS reliable FROM lines")
# Layout roles, and which of them are never read or only on demand.
POLICY = "CASE WHEN role IN ('header', 'footer', 'footnote', 'vision_footnote', 'number', 'formula_number', 'seal') THEN 'never' WHEN role IN ('algorithm', 'chart', 'formula', 'image', 'reference', 'reference_content', 'table') THEN 'on_demand' WHEN role = 'unknown' THEN NULL ELSE 'automatic' END"
ROLES = "(VALUES ('header'), ('footer'), ('footnote'), ('vision_footnote'), ('number'), ('formula_number'), ('seal'), ('algorithm'), ('chart'), ('formula'), ('image'), ('reference'), ('reference_content'), ('table'), ('doc_title'), ('figure_title'), ('paragraph_title'), ('abstract'), ('content'), ('text'), ('aside_text'), ('unknown')) AS r(role)"
q("prj_layout_policy", f"SELECT role, {POLICY} AS disposition FROM {ROLES}")
q("prj_layout_class", f"SELECT role, CASE WHEN role IN ('doc_title', 'figure_title', 'paragraph_title') THEN 'heading' WHEN role IN ('footnote', 'vision_footnote') THEN 'note' WHEN role = 'table' THEN 'table' WHEN role = 'chart' THEN 'chart' WHEN {POLICY} IN ('on_demand', 'never') OR {POLICY} IS NULL THEN 'unsupported' ELSE 'prose' END AS content_class FROM {ROLES}")
HYPHEN = "regexp_replace(text, $R'([A-Za-zÀ-ÿ])-\n([A-Za-zÀ-ÿ])', {ref}$G)"
NORMAL = "SELECT block_id, trim(regexp_replace({joined}, $R'[ \t\r\n]+', ' '$G)) AS normalized, text LIKE '%-' || chr(10) || '%' AS has_hyphen FROM truth WHERE text IS NOT NULL"
q("prj_normalize_text", NORMAL.format(joined=HYPHEN.format(ref="'$1$2'")), NORMAL.format(joined=HYPHEN.format(ref=r"'\1\2'")))
q("prd_classify_content", "SELECT block_id, CASE WHEN coalesce(confidence, 0) < 0.6 THEN 'unsupported' WHEN text LIKE '%' || chr(9) || '%' OR text LIKE '%|%' THEN 'table' WHEN $LIKE(text, $R'\\.{3,}\\s*[0-9]+') THEN 'prose' WHEN $LIKE(lower(trim(text)), '^(footnote|nota al pie|nota de rodapé)') THEN 'note' ELSE 'prose' END AS content_class FROM lines WHERE text IS NOT NULL")
FOLIO = "$LIKE(trim(text), '^([0-9]{1,5}|[ivxlIVXL]{1,5})$')"
q("prd_running_folio", f"SELECT block_id, {FOLIO} AS folio FROM lines WHERE text IS NOT NULL")
q("prd_toc_entry", "SELECT block_id, $LIKE(text, $R'[A-Za-z].*\\.{3,}\\s*[0-9]+\\s*$') AS toc FROM lines WHERE text IS NOT NULL")
q("prd_note_numeral", "SELECT block_id, regexp_extract(text, $R'^([0-9]{1,3})([.)\\]](\\s|$)| [A-ZÁÉÍÓÚÀÂÃÇÊÔ])', 1) AS numeral FROM lines WHERE text IS NOT NULL")
PREV = "lag(y + h / 2) OVER w AS pcy, lag(h) OVER w AS ph, lag(x) OVER w AS px, lag(w) OVER w AS pw"
WIN = "WINDOW w AS (PARTITION BY document_id, page_index ORDER BY y DESC, x, block_id)"
MED = "(SELECT document_id, page_index, $AT($SORT($LIST(h)), cast(count(*) $DIV 2 AS int) + 1) AS mh FROM lines WHERE h IS NOT NULL GROUP BY document_id, page_index)"
SAME = "(abs(y + h / 2 - pcy) < 0.5 * mh AND x - (px + pw) BETWEEN -0.5 * mh AND mh)"
LAGGED = f"(SELECT l.*, m.mh, {PREV} FROM lines l JOIN {MED} m ON l.document_id = m.document_id AND l.page_index = m.page_index {WIN.replace('document_id', 'l.document_id').replace('page_index', 'l.page_index').replace('y DESC', 'l.y DESC').replace(' x,', ' l.x,').replace('block_id', 'l.block_id')})"
LAGGED = LAGGED.replace("lag(y + h / 2)", "lag(l.y + l.h / 2)").replace("lag(h)", "lag(l.h)").replace("lag(x)", "lag(l.x)").replace("lag(w)", "lag(l.w)")
q("prd_same_visual_line", f"SELECT block_id, coalesce({SAME}, false) AS same_line FROM {LAGGED} t")
q("prd_trusted_prose", "SELECT document_id, page_index, bool_or(coalesce(confidence, 0) >= 0.6 AND text IS NOT NULL AND text NOT LIKE '%|%') AS trusted FROM lines GROUP BY document_id, page_index")
q("prj_ocr_record", "SELECT request_id, CASE WHEN n_ocr > 0 THEN 'ocr' ELSE 'direct' END AS route, CASE WHEN n_ocr > 0 AND ocr_status = 'completed' THEN 'ocr_completed' WHEN ocr_status = 'failed' THEN 'ocr_insufficient' WHEN raster THEN 'ocr_forced' ELSE 'direct_text_useful' END AS reason_code, CASE WHEN raster THEN 'vision-v1' ELSE 'direct-v1' END AS processor_revision, CASE WHEN ocr_status = 'failed' THEN 'degraded' ELSE 'completed' END AS status, ocr_error_code AS error_code FROM candidates")
q("prj_page_status", "SELECT request_id, CASE WHEN n_direct + n_ocr = 0 THEN 'failed' WHEN ocr_status = 'failed' THEN 'degraded' ELSE 'completed' END AS status, CASE WHEN n_direct + n_ocr = 0 THEN 'direct_text_empty' END AS reason FROM candidates")
q("prd_narrable", "SELECT block_id, coalesce(CASE degradation WHEN 'unreadable' THEN 'never' END, CASE WHEN text IS NOT NULL AND trim(text) <> '' THEN 'automatic' ELSE 'never' END) = 'automatic' AS narrable FROM truth")
q("prd_translatable", "SELECT block_id FROM truth WHERE degradation IS NULL AND text IS NOT NULL AND confidence >= 0.7")
q("prd_translation_direction", "SELECT unit_id, coalesce(source_language IN ('es', 'en', 'pt') AND target_language IN ('es', 'en', 'pt') AND source_language <> target_language, false) AS supported FROM tunits")
q("prd_voice_pair", "SELECT u.unit_id, p.voice IS NOT NULL AS allowed FROM units u LEFT JOIN (SELECT * FROM (VALUES ('quill', 'es'), ('lira', 'es'), ('sauce', 'es'), ('bruma', 'pt'), ('tern', 'pt'), ('sauce', 'en'), ('quill', 'en')) AS v(voice, lang)) p ON $PART(u.voice_id, '-', 1) = p.voice AND $PART(u.voice_id, '-', 2) = p.lang")
q("prd_tts_units", "SELECT job_id, count(*) <= 64 AND count(DISTINCT unit_id) = count(*) AND bool_and(length(unit_id) BETWEEN 1 AND 256) AND bool_and(coalesce(trim(text), '') <> '' AND coalesce($BYTES(text), 0) <= 524288) AS valid FROM units GROUP BY job_id")
q("prd_valid_id", "SELECT unit_id, $LIKE(unit_id, '^[A-Za-z0-9_-]{1,128}$') AS corpus_id, $LIKE(coalesce(anchor_id, ''), '^[A-Za-z0-9_+.-]{1,128}$') AS model_id FROM units")
q("prd_sha256_hex", "SELECT document_id, coalesce($LIKE(sha256_hex, '^[0-9a-f]{64}$'), false) AS valid, substr(sha256_hex, 1, 32) AS document_key, substr(sha256_hex, 1, 16) AS short_key FROM entries")
q("prd_safe_path", "SELECT document_id, $LIKE(file_path, '^[^/]') AND NOT $LIKE(file_path, $R'(^|/)\\.{1,2}(/|$)') AND NOT file_path LIKE '%//%' AS safe FROM entries WHERE file_path IS NOT NULL")
q("prd_artifact", "SELECT document_id, NOT $LIKE(lower(file_path), $R'\\.(exe|dll|dylib|so|sh|py|js)$') AS data_file, $LIKE('https://host.example/' || coalesce(sha256_hex, 'main') || '/' || file_path, '^https://[^/]+/[0-9a-f]{64}/') AS pinned FROM entries WHERE file_path IS NOT NULL")
q("prd_truth_region", "SELECT block_id, coalesce(rx >= 0 AND ry >= 0 AND rw > 0 AND rh > 0 AND rx + rw <= 1.0 AND ry + rh <= 1.0, false) AS valid FROM truth")
q("prd_gate_metric", "SELECT m.event_id, m.name IN ('click', 'view', 'error') AS known, m.seq BETWEEN 1 AND 100 AND m.numerator >= 0 AS valid FROM metrics m")
q("prd_gate_request", "SELECT o_orderkey AS request, $LIKE(o_orderpriority, '^[A-Za-z0-9 _+.-]{1,128}$') AND o_custkey BETWEEN 1 AND 10000 AND o_totalprice BETWEEN 1 AND 7200000 AS valid FROM orders")
q("prd_resource_sample", "SELECT event_id, (numerator > 0 OR seq > 0) AND clock_ms > 0 AS valid FROM metrics")
q("prd_needs_ocr_repair", "SELECT block_id, $LIKE(text, $R'[#�]|:!|\\S!\\S') AS needs_repair FROM lines WHERE text IS NOT NULL".replace("\\uFFFD", "�"))
LETTERS = "length(regexp_replace({c}, '[^A-Za-zÀ-ÖØ-öø-ÿ]', ''$G))"
NONASCII = "length(regexp_replace({c}, '[^À-ÖØ-öø-ÿ]', ''$G))"
# All text of a page, as the layer has it and as it was recognised; only letters are counted, so their order is any.
PAIR = "(SELECT t.document_id, t.page_index, t.text AS existing, l.text AS recognised FROM (SELECT document_id, page_index, $JOIN($SORT($LIST(text)), ' ') AS text FROM truth WHERE degradation = 'scanned' AND text IS NOT NULL GROUP BY document_id, page_index) t JOIN (SELECT document_id, page_index, $JOIN($SORT($LIST(text)), ' ') AS text FROM lines WHERE text IS NOT NULL GROUP BY document_id, page_index) l ON t.document_id = l.document_id AND t.page_index = l.page_index)"
q("prd_broken_layer", f"SELECT document_id, page_index, {NONASCII.format(c='recognised')} >= 8 AND {NONASCII.format(c='existing')} * 10 < {NONASCII.format(c='recognised')} AS broken FROM {PAIR} p")
q("prd_embed_route", f"SELECT document_id, page_index, CASE WHEN {LETTERS.format(c='existing')} * 5 < {LETTERS.format(c='recognised')} THEN 'over' WHEN {NONASCII.format(c='existing')} * 10 < {NONASCII.format(c='recognised')} THEN 'replace' ELSE 'none' END AS route FROM {PAIR} p")
q("prj_visible_text", "SELECT unit_id, CASE WHEN source_language IS NOT NULL AND unit_index % 2 = 0 THEN upper(target_language) || ': ' || text ELSE text END AS visible FROM tunits WHERE text IS NOT NULL")
q("prj_voice_language", "SELECT document_id, coalesce(CASE WHEN lower(trim(language)) IN ('es', 'en', 'pt') THEN lower(trim(language)) END, 'es') AS voice_language FROM entries")
q("prd_restart_snapshot", "SELECT o_orderkey AS id, o_custkey >= 0 AND o_orderstatus IN ('O', 'F', 'P') AND o_totalprice / 100000.0 BETWEEN 0.5 AND 3 AS valid FROM orders")
q("prd_narration_rate", "SELECT o_orderkey AS id, greatest(0.5, least(2.0, floor(o_totalprice) / 100000.0)) AS rate FROM orders")
q("prd_runtime_manifest", "SELECT count(*) = count(DISTINCT document_id) AND count(DISTINCT file_path) = count(file_path) AS unique_ids, bool_and($LIKE(document_id, '^[a-z0-9-]+$')) AS ids_ok, bool_and(sha256_hex IS NULL OR $LIKE(sha256_hex, '^[0-9a-f]{64}$')) AS hashes_ok FROM entries")
q("prd_forbidden_sentinel", "SELECT doc_id, NOT (text LIKE '%@pausa%' OR text LIKE '%voz@2x%' OR text LIKE '%BEGIN PRIVATE%') AS clean FROM documents WHERE text IS NOT NULL")
# 2.11
q("prd_truth_valid", "SELECT document_id, page_index, count(*) = max(block_order) - min(block_order) + 1 AND count(DISTINCT block_order) = count(*) AS dense, bool_and(text IS NULL OR trim(text) <> '' OR degradation = 'unreadable') AS text_ok FROM truth GROUP BY document_id, page_index")
q("prd_entry_valid", "SELECT document_id, coalesce($LIKE(sha256_hex, '^[0-9a-f]{64}$'), false) AND byte_size > 0 AND coalesce(page_count, 0) BETWEEN 1 AND 100000 AND entry_role IN ('matrix', 'long_form', 'adversarial') AS valid FROM entries")
q("prd_path_contained", "SELECT document_id, file_path LIKE 'documents/%' AND file_path NOT LIKE '%..%' AS contained FROM entries WHERE file_path IS NOT NULL")
q("prd_manifest_valid", "SELECT entry_role, count(*) BETWEEN 1 AND 100000 AND bool_and($LIKE(document_id, '^[A-Za-z0-9_+.-]{1,128}$')) AND bool_and(lower(coalesce(language, '')) NOT IN ('main', 'latest')) AS valid FROM entries GROUP BY entry_role")
q("prd_runtime_match", "SELECT u.unit_id, e.document_id IS NOT NULL AND lower(trim(e.language)) = $PART(u.voice_id, '-', 2) AS matches FROM units u LEFT JOIN entries e ON u.document_id = e.document_id")
q("prj_voices_for_language", "SELECT DISTINCT $PART(voice_id, '-', 2) AS language, $PART(voice_id, '-', 1) AS voice FROM units")
q("prj_page_metric_rows", "SELECT request_id, 'nfr6' AS name, n_direct AS numerator, n_direct + n_ocr AS denominator FROM candidates UNION ALL SELECT request_id, 'cer', n_ocr, greatest(1, n_direct + n_ocr) FROM candidates")
q("prj_anchor_report", "SELECT document_id, page_index, max(x) - min(x) >= 200 AS multi_column, count_if(confidence >= 0.75) AS reliable, count_if(confidence < 0.75) AS unreliable, count_if(confidence IS NULL) AS unavailable FROM lines GROUP BY document_id, page_index")
q("prd_gate_result", "SELECT request_id, ocr_status IS NULL OR (ocr_status IN ('completed', 'failed') AND (ocr_status = 'failed') = (ocr_error_code IS NOT NULL)) AS consistent FROM candidates")
q("prj_incomplete_run", "SELECT request_id, CASE WHEN ocr_status = 'failed' THEN 'incomplete' ELSE 'complete' END AS status, CASE WHEN ocr_status = 'failed' THEN 0.0 ELSE 1.0 END AS confidence, ocr_error_code AS error FROM candidates")
q("prj_sample_text", "WITH p AS (SELECT document_id, page_index, min(text) AS text, row_number() OVER (PARTITION BY document_id ORDER BY page_index) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS n FROM paragraphs GROUP BY document_id, page_index) SELECT document_id, page_index, text FROM p WHERE n <= 8 OR i IN (0, n $DIV 8, 2 * n $DIV 8, 3 * n $DIV 8, 4 * n $DIV 8, 5 * n $DIV 8, 6 * n $DIV 8, 7 * n $DIV 8)")
q("prj_recogniser_locale", "SELECT document_id, CASE lower(trim(language)) WHEN 'es' THEN 'es-ES' WHEN 'pt' THEN 'pt-BR' ELSE 'en-US' END AS locale FROM entries")
q("prj_translated_rows", "SELECT 't-' || unit_id AS translated_unit_id, unit_id AS source_unit_id, row_number() OVER (PARTITION BY request_id ORDER BY unit_index, unit_id) - 1 AS order_key, coalesce(trim(text), '') = '' AS failed FROM tunits")
q("prd_segment_valid", "SELECT unit_id, segment_index, sample_count > 0 AND sample_rate_hz BETWEEN 8000 AND 384000 AND elapsed_ms > 0 AS valid FROM segments")
q("prd_tts_result_header", "SELECT job_id, count(DISTINCT voice_id) = 1 AS one_voice, count(DISTINCT document_id) = 1 AS one_document FROM units GROUP BY job_id")
q("prd_package_changed", "WITH a AS (SELECT file_path, byte_size FROM entries), b AS (SELECT file_path, max(byte_size) + CASE WHEN file_path LIKE '%1.pdf' THEN 1 ELSE 0 END AS byte_size FROM entries GROUP BY file_path) SELECT file_path FROM (SELECT * FROM a EXCEPT SELECT * FROM b) d")
q("prj_formula_sample", "SELECT document_id, page_index, label FROM (SELECT document_id, page_index, CASE WHEN bool_or(lower(text) LIKE '%fig. %') THEN 'formula' ELSE 'not_formula' END AS label, row_number() OVER (PARTITION BY document_id ORDER BY page_index) AS rn FROM paragraphs GROUP BY document_id, page_index) t WHERE rn <= 5")
q("prd_corpus_contract", "SELECT count(DISTINCT entry_role) = 3 AS roles, count(DISTINCT lower(trim(language))) >= 3 AS languages, count(DISTINCT document_id) = count(*) AS exact_ids FROM entries")
q("st_translation_cancel", "SELECT unit_id, request_id FROM (SELECT *, bool_and(coalesce(trim(text), '') <> '') OVER (PARTITION BY request_id) AS whole FROM tunits) t WHERE whole AND unit_index % 3 <> 0")
q("prd_page_outcome", "SELECT request_id, CASE WHEN n_direct + n_ocr > 0 OR ocr_error_code IS NULL THEN 'complete' ELSE 'fail' END AS outcome FROM candidates")
q("prj_seek_clamp", "SELECT unit_id, segment_index, greatest(0, least(elapsed_ms, sample_count - 1)) AS frame FROM segments")
q("st_pending_events", "SELECT user_id AS job, max_by(event_type, event_id) AS terminal_event, max(event_id) AS event_id FROM events GROUP BY user_id")
q("st_session_valid", "SELECT document_id, count_if(ocr_status = 'failed') = count_if(ocr_error_code IS NOT NULL) AS codes_ok, count(DISTINCT page_index) = count(*) AS dense_pages FROM candidates GROUP BY document_id")
q("st_model_install", "SELECT run_id, event_id, numerator >= max(numerator) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS monotone FROM metrics")
