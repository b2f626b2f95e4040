"""Contract rules, joins of records and set operations whose two forms are written apart."""

from .catalog import oracle, q
from .pages import FOLD, PG, on

# sources and sinks ------------------------------------------------------------------------------------------------
KNOWN = "event_type IN ('click', 'view', 'signup', 'purchase')"
q(
    "src_request_envelope",
    f"SELECT event_id, event_type AS command, cast(get_json_object(props, '$.k') AS int) AS argument, CASE WHEN props IS NULL OR get_json_object(props, '$') IS NULL THEN 'INVALID_JSON' WHEN NOT {KNOWN} THEN 'UNKNOWN_COMMAND' WHEN get_json_object(props, '$.k') IS NULL THEN 'INVALID_ARGUMENT' END AS error FROM events",
    f"SELECT event_id, event_type AS command, CASE WHEN json_valid(props) THEN cast(json_extract_string(props, '$.k') AS int) END AS argument, CASE WHEN props IS NULL OR NOT json_valid(props) THEN 'INVALID_JSON' WHEN NOT {KNOWN} THEN 'UNKNOWN_COMMAND' WHEN json_extract_string(props, '$.k') IS NULL THEN 'INVALID_ARGUMENT' END AS error FROM events",
)
q("src_ocr_page", f"SELECT l.block_id, row_number() OVER (PARTITION BY l.document_id, l.page_index ORDER BY floor((l.y + l.h / 2) / (p.max_top * 0.01)) DESC, l.x, l.block_id) AS pos FROM lines l JOIN page_lines p ON {on('l', 'p')} WHERE l.confidence IS NOT NULL AND l.block_id LIKE '%-ocr-%'")
LINES13 = ("array_join(slice(split(text, '\\n'), 2, 3), ' ')", "array_to_string(list_slice(string_split(text, chr(10)), 2, 4), ' ')")
PASSAGE = "SELECT block_id, passage, CASE WHEN passage = '' THEN 0 ELSE $SIZE($SPLIT(passage, ' ')) END AS words FROM (SELECT block_id, trim(regexp_replace({lines}, $R'\\s+', ' '$G)) AS passage FROM truth WHERE degradation = 'scanned' AND text IS NOT NULL) t"
q("src_text_passage", PASSAGE.format(lines=LINES13[0]), PASSAGE.format(lines=LINES13[1]))
q("src_counters_regex", "SELECT doc_id, $JOIN(regexp_extract_all(text, $R'\\p{L}+: ([0-9]+)\\.', 1), ',') AS counters FROM documents WHERE text IS NOT NULL")
ESC = "replace(replace({c}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
q("snk_event", f"SELECT request_id, '{{\"request_id\":\"' || {ESC.format(c='request_id')} || '\",\"kind\":\"' || kind || '\",\"code\":' || CASE WHEN code IS NULL THEN 'null' ELSE '\"' || {ESC.format(c='code')} || '\"' END || '}}' AS event FROM (SELECT request_id, CASE WHEN ocr_status = 'failed' THEN 'failed' ELSE 'completed' END AS kind, ocr_error_code AS code, row_number() OVER (PARTITION BY request_id ORDER BY page_index) AS rk FROM candidates) t WHERE rk = 1")
# A digest over any number of rows: of the sorted digests of 4,096 parts, so that no task sorts all.
DIGEST = "SELECT {g}, $SHA($JOIN($SORT($LIST(part || ':' || d)), ',')$256) AS digest FROM (SELECT {g}, part, $SHA($JOIN($SORT($LIST(line)), chr(10))$256) AS d FROM (SELECT {g}, line, substr($SHA(line$256), 1, 3) AS part FROM ({src}) a) b GROUP BY {g}, part) c GROUP BY {g}"
q("snk_gate_artifacts", DIGEST.format(g="name", src="SELECT name, cast(event_id AS $STR) || chr(9) || cast(numerator AS $STR) || chr(9) || '0000' AS line FROM metrics"))
q("join_tree_digest", DIGEST.format(g="entry_role", src="SELECT entry_role, coalesce(file_path, '') || chr(9) || cast(coalesce(byte_size, 0) AS $STR) || chr(9) || coalesce(sha256_hex, '') AS line FROM entries"))
q("snk_state_prune", "SELECT folder FROM (SELECT CASE WHEN entry_role = 'matrix' THEN document_id ELSE 'doc_' || substr($SHA(document_id$256), 1, CASE WHEN required THEN 16 ELSE 15 END) END AS folder FROM entries) t WHERE $LIKE(folder, '^doc_[0-9a-f]{16}$')")

# predicates -------------------------------------------------------------------------------------------------------
q("prd_safe_error_code", "SELECT request_id, ocr_error_code IS NULL OR $LIKE(ocr_error_code, '^[A-Z0-9_]{1,128}$') AS safe FROM candidates", "SELECT request_id, ocr_error_code IS NULL OR (length(ocr_error_code) BETWEEN 1 AND 128 AND length(translate(ocr_error_code, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_', '')) = 0) AS safe FROM candidates")
q("prd_progress", "SELECT e.document_id, coalesce(c.completed, 0) AS completed, e.page_count AS total, coalesce(e.page_count > 0 AND coalesce(c.completed, 0) <= e.page_count, false) AS valid FROM entries e LEFT JOIN (SELECT document_id, count(DISTINCT page_index) AS completed FROM candidates WHERE ocr_status IS NULL OR ocr_status = 'completed' GROUP BY document_id) c ON c.document_id = e.document_id")
q("prd_nfr7_form", "SELECT reviewer, count(*) AS answers, count_if(score IS NULL) AS pending, count(*) = 15 AND bool_and(score IS NULL OR score BETWEEN 1 AND 5) AS valid FROM (SELECT o_custkey AS reviewer, CASE WHEN o_orderstatus <> 'P' THEN cast(substr(o_orderpriority, 1, 1) AS int) END AS score FROM orders) t GROUP BY reviewer")
q("prj_nfr7_package", "SELECT reviewer, passage, stimulus_id, lpad(cast(row_number() OVER (PARTITION BY reviewer ORDER BY stimulus_id) AS $STR), 3, '0') || '.m4a' AS file_name FROM (SELECT document_id AS reviewer, unit_id AS passage, substr($SHA('seed|' || document_id || '|' || unit_id$256), 1, 12) AS stimulus_id FROM units WHERE document_id IS NOT NULL) t")
q("prd_evidence_equal", f"SELECT c.document_id, c.page_index, coalesce(l.n, 0) = c.n_direct + c.n_ocr AS equal, c.n_direct + c.n_ocr > 0 AS positive FROM candidates c LEFT JOIN (SELECT {PG}, count(DISTINCT block_id) AS n FROM lines GROUP BY {PG}) l ON {on('c', 'l')}")

# joins ------------------------------------------------------------------------------------------------------------
q("join_page_route", f"SELECT c.request_id, c.document_id, c.page_index, CASE WHEN c.raster AND c.n_ocr > 0 THEN 'ocr' ELSE 'direct' END AS route, l.block_id FROM candidates c LEFT JOIN lines l ON {on('c', 'l')} AND CASE WHEN l.block_id LIKE '%-ocr-%' THEN 1 ELSE 0 END = CASE WHEN c.raster AND c.n_ocr > 0 THEN 1 ELSE 0 END")
q("join_truth", f"SELECT p.document_id, p.page_index, p.predicted, t.expected FROM (SELECT {PG}, $JOIN(transform_($SORT($LIST(lpad(cast(pos AS $STR), 6, '0') || coalesce(text, '')))), chr(10)) AS predicted FROM ordered GROUP BY {PG}) p JOIN (SELECT {PG}, $JOIN($SORT($LIST(lpad(cast(block_order AS $STR), 6, '0') || coalesce(text, ''))), chr(10)) AS expected FROM truth GROUP BY {PG}) t ON {on('p', 't')}".replace("transform_(", "("))
q("join_artifact_verify", "WITH d AS (SELECT file_path, sha256_hex, byte_size, row_number() OVER (PARTITION BY file_path ORDER BY received_at, document_id) AS i, row_number() OVER (PARTITION BY file_path ORDER BY received_at DESC, document_id DESC) AS j FROM manifest WHERE file_path IS NOT NULL) SELECT a.file_path, a.byte_size = b.byte_size AS size_ok, coalesce(a.sha256_hex = b.sha256_hex, false) AS hash_ok FROM d a JOIN d b ON a.file_path = b.file_path AND a.i = 1 AND b.j = 1")
CELLS = [(lang, a, c) for lang in ("es", "en", "pt") for a, c in (("single_column", "digital"), ("multi_column", "digital"), ("single_column", "scanned"), ("multi_column", "mixed"))]
q(
    "join_coverage_matrix",
    f"SELECT language, layout, content FROM (VALUES {', '.join(str(c) for c in CELLS)}) AS v(language, layout, content) WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.entry_role = 'matrix' AND lower(trim(e.language)) = v.language AND e.layout = v.layout AND e.content = v.content)",
    "SELECT language, layout, content FROM (SELECT unnest(['es', 'en', 'pt']) AS language), (SELECT unnest(['single_column', 'multi_column']) AS layout), (SELECT unnest(['digital', 'scanned', 'mixed']) AS content) WHERE content = 'digital' OR (content = 'scanned') = (layout = 'single_column') EXCEPT SELECT lower(trim(language)), layout, content FROM entries WHERE entry_role = 'matrix'",
)
q(
    "join_translation_bridge",
    "WITH r AS (SELECT DISTINCT request_id, unit_id FROM translation_units), t AS (SELECT request_id, unit_id, count(*) AS n FROM translation_units WHERE coalesce(trim(text), '') <> '' GROUP BY request_id, unit_id) SELECT r.request_id, count(*) AS units, count_if(t.n IS NULL) AS lost, count_if(t.n > 1) AS duplicated, count_if(coalesce(t.n, 0) <> 1) = 0 AS exact FROM r LEFT JOIN t ON r.request_id = t.request_id AND r.unit_id = t.unit_id GROUP BY r.request_id",
    "SELECT request_id, count(*) AS units, count(*) FILTER (n = 0) AS lost, count(*) FILTER (n > 1) AS duplicated, bool_and(n = 1) AS exact FROM (SELECT request_id, unit_id, count(*) FILTER (coalesce(trim(text), '') <> '') AS n FROM translation_units GROUP BY ALL) t GROUP BY request_id",
)
q("join_review_key", "SELECT u.unit_id AS stimulus, u.voice_id AS reviewer, e.document_id AS passage, lower($PART(u.voice_id, '-', 2)) = lower(trim(e.language)) AS same_language FROM units u JOIN entries e ON u.document_id = e.document_id")
q("join_annotations_default", "WITH p AS (SELECT document_id, page_index, max(CASE WHEN degradation = 'unreadable' THEN 2 WHEN $LIKE(coalesce(text, ''), '[=±×÷√∑∫]') THEN 1 ELSE 0 END) AS kind FROM truth GROUP BY document_id, page_index) SELECT c.request_id, CASE p.kind WHEN 2 THEN 'ambiguous' WHEN 1 THEN 'formula' ELSE 'not_formula' END AS expected, coalesce(p.kind, 0) = 2 AS needs_review FROM candidates c LEFT JOIN p ON c.document_id = p.document_id AND c.page_index = p.page_index")
q("join_process_tree", "WITH RECURSIVE tree AS (SELECT c_custkey AS pid, c_custkey AS root, 0 AS depth FROM customer WHERE c_custkey < 10 UNION ALL SELECT c.c_custkey, t.root, t.depth + 1 FROM tree t JOIN customer c ON c.c_custkey $DIV 10 = t.pid AND c.c_custkey >= 10) SELECT root, count(*) AS processes, max(depth) AS depth, cast(sum(pid) AS bigint) AS total FROM tree GROUP BY root", "SELECT cast(substr(cast(c_custkey AS varchar), 1, 1) AS bigint) AS root, count(*) AS processes, max(length(cast(c_custkey AS varchar)) - 1) AS depth, cast(sum(c_custkey) AS bigint) AS total FROM customer GROUP BY 1")

# aggregates -------------------------------------------------------------------------------------------------------
q("agg_nfr7_means", "SELECT language, passage, count(*) AS n, round(avg(naturalness), 6) AS naturalness, round(avg(pronunciation), 6) AS pronunciation, count_if(high) AS high_defects, count(*) >= 15 AND avg(naturalness) >= 4 AND avg(pronunciation) >= 4 AND count_if(high) = 0 AS passed FROM (SELECT o_orderpriority AS language, o_custkey AS passage, 6 - cast(substr(o_orderpriority, 1, 1) AS int) AS naturalness, CASE WHEN o_orderstatus = 'F' THEN 5 ELSE 4 END AS pronunciation, o_totalprice > 400000 AS high FROM orders) r GROUP BY GROUPING SETS ((language), (language, passage))")
CONF = "(SELECT $LIKE(coalesce(text, ''), '[=±×÷√∑∫]') AS expected, $LIKE(coalesce(text, ''), '[0-9]{2,}.*[+=/]') AS predicted, degradation = 'unreadable' AS abstain FROM (SELECT text, coalesce(degradation, '') AS degradation FROM truth) z) t"
q("agg_confusion", f"SELECT count_if(expected AND predicted AND NOT abstain) AS tp, count_if(NOT expected AND NOT predicted AND NOT abstain) AS tn, count_if(NOT expected AND predicted AND NOT abstain) AS fp, count_if(expected AND NOT predicted AND NOT abstain) AS fn, count_if(abstain) AS abstained, round(count_if(expected AND predicted AND NOT abstain) * 1.0 / nullif(count_if(predicted AND NOT abstain), 0), 6) AS precision_, round(count_if(expected AND predicted AND NOT abstain) * 1.0 / nullif(count_if(expected AND NOT abstain), 0), 6) AS recall FROM {CONF}")
# Upper medians without gathering a group's values: the smallest value that half of them, from above, reach.
HALF = "cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY {v} DESC) AS bigint) AS median_{v}, max({v}) AS max_{v}"
q("agg_series_summary", f"SELECT name, count(*) AS n, {HALF.format(v='numerator')}, {HALF.format(v='seq')}, {HALF.format(v='event_id')} FROM metrics GROUP BY name")
q("agg_corpus_perf_gate", "SELECT e.document_id, count(c.ocr_elapsed_ms) AS samples, cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY c.ocr_elapsed_ms DESC) AS bigint) AS median_ms, count(c.ocr_elapsed_ms) = 3 AND coalesce(percentile_disc(0.5) WITHIN GROUP (ORDER BY c.ocr_elapsed_ms DESC) <= max(CASE WHEN e.layout = 'multi_column' THEN 1600 ELSE 750 END), false) AS passed FROM entries e LEFT JOIN (SELECT * FROM candidates WHERE ocr_status = 'completed') c ON c.document_id = e.document_id GROUP BY e.document_id", "SELECT e.document_id, len(s) AS samples, s[len(s) // 2 + 1] AS median_ms, len(s) = 3 AND s[2] <= CASE WHEN e.layout = 'multi_column' THEN 1600 ELSE 750 END AS passed FROM entries e LEFT JOIN (SELECT document_id, list(ocr_elapsed_ms ORDER BY ocr_elapsed_ms) AS s FROM candidates WHERE ocr_status = 'completed' AND ocr_elapsed_ms IS NOT NULL GROUP BY document_id) c ON c.document_id = e.document_id".replace("len(s) AS samples", "coalesce(len(s), 0) AS samples").replace("len(s) = 3 AND s[2] <=", "coalesce(len(s) = 3, false) AND s[2] <="))

# windows ----------------------------------------------------------------------------------------------------------
q(
    "win_chapter_windows",
    "SELECT job, start_ms, end_ms FROM (SELECT job, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY job ORDER BY rn), total) AS end_ms FROM (SELECT job, rn, cast(coalesce(sum(duration_ms) OVER (PARTITION BY job ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start_ms, cast(sum(duration_ms) OVER (PARTITION BY job) AS bigint) AS total FROM fragments) a) t WHERE end_ms > start_ms",
    "SELECT job, end_ms - duration_ms AS start_ms, end_ms FROM (SELECT job, duration_ms, cast(sum(duration_ms) OVER (PARTITION BY job ORDER BY rn) AS bigint) AS end_ms FROM fragments) t WHERE duration_ms > 0",
)
ARRIVED = "(SELECT request_id, unit_id, min(unit_index) AS unit_index, min(received_at) AS arrived FROM translation_units GROUP BY request_id, unit_id)"
q("win_strictly_increasing", f"SELECT request_id, bool_and(coalesce(unit_index > prev, true)) AS increasing FROM (SELECT request_id, unit_index, lag(unit_index) OVER (PARTITION BY request_id ORDER BY arrived, unit_id) AS prev FROM {ARRIVED} a) t GROUP BY request_id", f"SELECT request_id, list_sort(k) = k AND len(list_distinct(k)) = len(k) AS increasing FROM (SELECT request_id, list(unit_index ORDER BY arrived, unit_id) AS k FROM {ARRIVED} a GROUP BY request_id) t")
q("win_nondecreasing_clock", "SELECT run_id, bool_and(coalesce(clock_ms >= prev, true)) AS ordered FROM (SELECT run_id, clock_ms, lag(clock_ms) OVER (PARTITION BY run_id ORDER BY event_id) AS prev FROM metrics) t GROUP BY run_id", "SELECT run_id, list_sort(c) = c AS ordered FROM (SELECT run_id, list(clock_ms ORDER BY event_id) AS c FROM metrics GROUP BY run_id) t")
q("srt_longest_run", "SELECT job_id, first_index, length_ FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY length_ DESC, first_index) AS rk FROM (SELECT job_id, min(unit_index) AS first_index, count(*) AS length_ FROM (SELECT job_id, unit_index, unit_index - row_number() OVER (PARTITION BY job_id ORDER BY unit_index, unit_id) AS island FROM units WHERE coalesce(trim(text), '') <> '') a GROUP BY job_id, island) b) t WHERE rk = 1")

# A snapshot is saved, taken once, or cleared: a take finds what was saved if nothing came between.
ACT = "CASE event_type WHEN 'purchase' THEN 'save' WHEN 'view' THEN 'take' WHEN 'signup' THEN 'clear' END"
q(
    "st_restart_snapshot",
    f"SELECT user_id, event_id, CASE WHEN prev = 'save' THEN saved END AS taken FROM (SELECT user_id, event_id, act, lag(act) OVER w AS prev, lag(event_id) OVER w AS saved FROM (SELECT user_id, event_id, {ACT} AS act FROM events) a WHERE act IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) t WHERE act = 'take'",
    f"WITH a AS (SELECT user_id, event_id, {ACT} AS act FROM events) SELECT t.user_id, t.event_id, CASE WHEN p.act = 'save' THEN p.event_id END AS taken FROM a t ASOF LEFT JOIN (SELECT * FROM a WHERE act IS NOT NULL) p ON p.user_id = t.user_id AND p.event_id < t.event_id WHERE t.act = 'take'",
)

# sets -------------------------------------------------------------------------------------------------------------
WANTED = "requested AS (SELECT document_id, page_index FROM candidates), covered AS (SELECT DISTINCT document_id, page_index FROM lines WHERE text IS NOT NULL), failed AS (SELECT document_id, page_index FROM candidates WHERE ocr_status = 'failed')"
q(
    "set_exact_cover",
    f"WITH {WANTED}, gap AS (SELECT * FROM requested EXCEPT (SELECT * FROM covered UNION SELECT * FROM failed)), twice AS (SELECT * FROM covered INTERSECT SELECT * FROM failed) SELECT d.document_id, coalesce(g.n, 0) AS uncovered, coalesce(t.n, 0) AS overlapping FROM (SELECT DISTINCT document_id FROM requested) d LEFT JOIN (SELECT document_id, count(*) AS n FROM gap GROUP BY document_id) g ON g.document_id = d.document_id LEFT JOIN (SELECT document_id, count(*) AS n FROM twice GROUP BY document_id) t ON t.document_id = d.document_id",
    f"WITH {WANTED} SELECT r.document_id, count(DISTINCT r.page_index) FILTER (c.page_index IS NULL AND f.page_index IS NULL) AS uncovered, count(DISTINCT r.page_index) FILTER (c.page_index IS NOT NULL AND f.page_index IS NOT NULL) AS overlapping FROM requested r LEFT JOIN covered c ON {on('r', 'c')} LEFT JOIN failed f ON {on('r', 'f')} GROUP BY r.document_id",
)
q("set_append_distinct", "SELECT job_id, unit_id, row_number() OVER (PARTITION BY job_id ORDER BY at, unit_id) AS pos FROM (SELECT job_id, unit_id, min(received_at) AS at FROM audiobook_units GROUP BY job_id, unit_id) t", "SELECT job_id, unit_id, row_number() OVER (PARTITION BY job_id ORDER BY received_at, unit_id) AS pos FROM (SELECT * FROM audiobook_units QUALIFY row_number() OVER (PARTITION BY job_id, unit_id ORDER BY received_at) = 1) t")
q("set_word_intersection", f"WITH a AS (SELECT DISTINCT document_id, page_index, $EXPLODE($SPLIT({FOLD}, ' ')) AS word FROM truth WHERE text IS NOT NULL), b AS (SELECT DISTINCT document_id, page_index, $EXPLODE($SPLIT({FOLD}, ' ')) AS word FROM lines WHERE text IS NOT NULL) SELECT document_id, page_index, count(*) AS shared FROM (SELECT * FROM a INTERSECT SELECT * FROM b) i WHERE word <> '' GROUP BY document_id, page_index")

# forms of queries that pipeline builds ----------------------------------------------------------------------------
oracle("fn_fold", "SELECT block_id, strip_accents(lower(trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')))) AS folded FROM truth WHERE text IS NOT NULL")
oracle("fn_visual_match", "WITH r AS (SELECT vec_id, list_transform(embedding, lambda v: cast(floor((v + 1) * 127.5) AS int)) AS px FROM embeddings), p AS (SELECT a.vec_id, list_transform(range(1, len(a.px) // 4 + 1), lambda i: abs(a.px[4 * i - 3] - b.px[4 * i - 3]) > 5 OR abs(a.px[4 * i - 2] - b.px[4 * i - 2]) > 5 OR abs(a.px[4 * i - 1] - b.px[4 * i - 1]) > 5) AS d FROM r a JOIN r b ON b.vec_id = a.vec_id + 1) SELECT vec_id, len(list_filter(d, lambda x: x)) AS differing, len(list_filter(d, lambda x: x)) * 200 <= len(d) AS matches FROM p")
oracle("fn_spoken_normalize", "SELECT doc_id, CASE WHEN lower(trim(lang)) = 'en' THEN regexp_replace(t, '(^|[^\\p{L}\\p{N}])CHAPTER I($|[^\\p{L}\\p{N}])', '\\1Chapter one\\2', 'g') ELSE t END AS normalized FROM (SELECT doc_id, lang, trim(regexp_replace(nfc_normalize(text), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL) d")
