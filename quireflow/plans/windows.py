"""Window and ordered-sequence operators, sort and top-k, and ordered state in batch form (2.9)."""

from .aggregates import upper_median
from .catalog import q

EDGE = """WITH m AS (SELECT document_id, page_index, {med} AS mh, count(*) AS n FROM lines WHERE h IS NOT NULL GROUP BY document_id, page_index),
o AS (SELECT l.document_id, l.page_index, l.block_id, m.mh, m.n, l.y + l.h / 2 AS cy, row_number() OVER a AS i, lag(l.y + l.h / 2) OVER a AS up, row_number() OVER b AS j, lag(l.y + l.h / 2) OVER b AS down FROM lines l JOIN m ON l.document_id = m.document_id AND l.page_index = m.page_index WHERE l.h IS NOT NULL
  WINDOW a AS (PARTITION BY l.document_id, l.page_index ORDER BY l.y + l.h / 2 DESC, l.block_id), b AS (PARTITION BY l.document_id, l.page_index ORDER BY l.y + l.h / 2, l.block_id)),
g AS (SELECT *, sum(CASE WHEN up - cy > 3 * mh THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_index ORDER BY i) AS gaps_above, sum(CASE WHEN cy - down > 3 * mh THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_index ORDER BY j) AS gaps_below FROM o)
SELECT document_id, page_index, block_id, 'top' AS edge FROM g WHERE i <= least(6, n $DIV 2) AND gaps_above <= 1
UNION ALL SELECT document_id, page_index, block_id, 'bottom' FROM g WHERE j <= least(6, n $DIV 2) AND gaps_below <= 1""".replace("{med}", upper_median("h"))
q("win_edge_cluster", EDGE)
q("win_segment_contiguity", "SELECT unit_id, segment_index, coalesce(sum(sample_count) OVER (PARTITION BY unit_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = segment_index * 25000 AS at_declared, cast(coalesce(sum(sample_count) OVER (PARTITION BY unit_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS unit_sample_offset FROM segments")
q("win_fragment_start", "SELECT job, unit_id, cast(coalesce(sum(duration_ms) OVER (PARTITION BY job ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start_ms FROM fragments")
q("win_monotone_accept", "SELECT job, unit_id FROM (SELECT job, unit_id, duration_ms, max(duration_ms) OVER (PARTITION BY job ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM fragments) t WHERE best IS NULL OR duration_ms > best")
q("win_narration_from_current", "SELECT job_id, unit_id, pos FROM (SELECT job_id, unit_id, unit_index, row_number() OVER (PARTITION BY job_id ORDER BY unit_index, unit_id) AS pos FROM units WHERE coalesce(trim(text), '') <> '' AND unit_index >= 2) t WHERE pos <= 5")
q("win_translation_window", "SELECT request_id, unit_id FROM (SELECT request_id, unit_id, row_number() OVER (PARTITION BY request_id ORDER BY unit_index, unit_id) AS rn FROM tunits WHERE source_language IS NOT NULL) t WHERE rn <= 5")
q("win_reading_stream", "SELECT block_id, row_number() OVER (PARTITION BY document_id ORDER BY page_index, block_order, block_id) AS pos FROM paragraphs")
q("win_fragments_in_order", "SELECT document_id, page_index, count(*) AS found FROM (SELECT document_id, page_index, instr(text, ' ') AS a, instr(text, '. ') AS b FROM paragraphs) t WHERE a > 0 AND b > a GROUP BY document_id, page_index")
# sort, limit, top-k
q("srt_nearest_pending", "SELECT document_id, min_by(page_index, abs(page_index - 3) * 10000 + page_index) AS page_index FROM candidates WHERE ocr_status IS NULL GROUP BY document_id")
q("srt_hash_shuffle", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY $SHA('7|' || cast(c_nationkey AS $STR) || '|' || cast(c_custkey AS $STR)$256)) AS pos FROM customer")
q("srt_first_fixed_limit", "SELECT job_id, unit_id, (row_number() OVER (PARTITION BY job_id ORDER BY unit_index, unit_id) - 1) $DIV 64 AS batch FROM units")
# ordered state in batch form
q("st_next_page", "SELECT document_id, min(page_index) AS next_page FROM candidates WHERE ocr_status = 'failed' GROUP BY document_id")
q("st_export_resume", "SELECT f.job, f.unit_id, cast(sum(f.duration_ms) OVER (PARTITION BY f.job ORDER BY f.rn) AS bigint) AS end_ms FROM fragments f WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = f.unit_id AND o.o_orderstatus = 'F')")
q("st_translation_walk", "SELECT request_id, unit_id, (row_number() OVER (PARTITION BY request_id ORDER BY unit_index, unit_id) - 1) $DIV 5 AS round FROM tunits WHERE coalesce(trim(text), '') <> ''")
q("st_language_settle", "SELECT document_id, min_by(language, page_index) AS language FROM (SELECT u.document_id, u.unit_index AS page_index, $PART(u.voice_id, '-', 2) AS language, length(u.text) AS n FROM units u WHERE length(u.text) >= 100) t GROUP BY document_id")
