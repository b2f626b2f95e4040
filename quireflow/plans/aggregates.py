"""Aggregations. Percentiles follow the reference's own definition: the sorted value at round((n-1)*f)."""

from .catalog import q


def nearest(v: str, f: float) -> str:
    return f"$AT($SORT($LIST({v})), cast(round((count({v}) - 1) * {f}) AS int) + 1)"


def upper_median(v: str) -> str:
    return f"$AT($SORT($LIST({v})), cast(count({v}) $DIV 2 AS int) + 1)"


q("agg_percentile_nearest", f"SELECT document_id, page_index, {nearest('w', 0.1)} AS p10, {nearest('w', 0.75)} AS p75, {nearest('w', 0.9)} AS p90 FROM lines WHERE w IS NOT NULL GROUP BY document_id, page_index")
q("agg_median_upper", f"SELECT document_id, page_index, {upper_median('h')} AS median_h FROM lines WHERE h IS NOT NULL GROUP BY document_id, page_index")
q("agg_p95_is_max", "SELECT name, max(numerator) AS p95 FROM metrics GROUP BY name")
q("agg_page_span", "SELECT document_id, page_index, max(x + w) - min(x) AS span FROM lines GROUP BY document_id, page_index")
q("agg_group_confidence", "SELECT document_id, page_index, min(least(greatest(coalesce(confidence, 0), 0), 1)) AS confidence FROM lines GROUP BY document_id, page_index")
q("agg_corpus_summary", "SELECT count(*) AS entries, cast(sum(coalesce(page_count, 0)) AS bigint) AS pages, count_if(sha256_hex IS NOT NULL) AS hashed, bool_and(NOT required OR distributable) AS complete, bool_or(entry_role = 'long_form' AND coalesce(page_count, 0) >= 1000) AS long_form, bool_or(entry_role = 'adversarial') AS adversarial FROM entries")
q("agg_uniqueness", "SELECT count(*) - count(DISTINCT document_id) AS duplicate_ids, count(file_path) - count(DISTINCT file_path) AS duplicate_paths FROM manifest")
q("agg_manifest_total", "SELECT entry_role, cast(sum(byte_size) AS bigint) AS bytes, count(*) AS files, sum(byte_size) <= 17179869184 AS within FROM entries GROUP BY entry_role")
q("agg_rtf", "SELECT unit_id, cast(sum(elapsed_ms) AS bigint) AS synthesis_ms, cast(sum(sample_count * 1000 $DIV sample_rate_hz) AS bigint) AS audio_ms, round(sum(elapsed_ms) * 1.0 / greatest(1, sum(sample_count * 1000 $DIV sample_rate_hz)), 6) AS rtf FROM segments GROUP BY unit_id")
q("agg_tts_summary", f"SELECT unit_id, count(*) AS fragments, min_by(elapsed_ms, segment_index) AS first_ms, {upper_median('elapsed_ms')} AS median_ms, max(elapsed_ms) AS max_ms FROM segments GROUP BY unit_id")
q("agg_sustained_maxima", "SELECT run_id, max(numerator) AS max_value, max_by(numerator, seq) - min_by(numerator, seq) AS delta, bool_or(name = 'error') AS any_critical FROM metrics GROUP BY run_id")
q("agg_gate_checks", "SELECT run_id, max(numerator) <= 40000 AS memory_ok, count_if(name = 'error') = 0 AS thermal_ok, sum(numerator) <= 300000 AS total_ok FROM metrics GROUP BY run_id")
q("agg_run_confidence", "SELECT document_id, round(coalesce(avg(confidence), 1.0), 6) AS confidence FROM truth GROUP BY document_id")
q("agg_export_preflight", "SELECT job_id, count(*) AS units, cast(sum(CASE WHEN text IS NULL THEN 0 ELSE $SIZE($SPLIT(trim(text), $R'\\s+')) END) AS bigint) AS words, greatest(10000000, cast(sum(CASE WHEN text IS NULL THEN 0 ELSE $SIZE($SPLIT(trim(text), $R'\\s+')) END) AS bigint) * 18667) AS required_bytes, count_if(coalesce(trim(text), '') = '') AS unreadable FROM units GROUP BY job_id")
q("agg_session_progress", "SELECT document_id, count_if(ocr_status IS NULL OR ocr_status = 'completed') AS completed, count_if(ocr_status = 'failed') AS failed, round(count_if(ocr_status IS NULL OR ocr_status = 'completed') * 1.0 / count(*), 6) AS share FROM candidates GROUP BY document_id")
q("agg_translation_progress", "SELECT request_id, count_if(coalesce(trim(text), '') <> '') AS translated, count_if(coalesce(trim(text), '') = '') AS failed, count(*) AS units FROM tunits GROUP BY request_id")
q("agg_bounding_box", "SELECT document_id, page_index, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM lines GROUP BY document_id, page_index")
q("agg_overlay_body_size", f"SELECT document_id, page_index, round(least(22, greatest(9, {upper_median('h')} * 0.74)), 6) AS size FROM lines WHERE h IS NOT NULL GROUP BY document_id, page_index")
q("agg_audio_levels", "SELECT unit_id, max(abs(sample_count - 25000)) AS peak, round(sqrt(avg((sample_count - 25000) * (sample_count - 25000) * 1.0)), 4) AS rms, max(abs(sample_count - 25000)) >= 24000 AS clipping FROM segments GROUP BY unit_id")
q("agg_furniture_nonautomatic", "WITH f AS (SELECT document_id, trim(text) AS title FROM lines WHERE h < 12 GROUP BY document_id, trim(text)) SELECT f.document_id, count(DISTINCT f.title) AS fragments, count(DISTINCT t.block_id) AS blocks FROM f LEFT JOIN paragraphs t ON t.document_id = f.document_id AND trim(t.text) = f.title GROUP BY f.document_id")
q("agg_language_vote", "WITH v AS (SELECT document_id, lower($PART(voice_id, '-', 2)) AS lang, cast(sum(coalesce(length(text), 0)) AS bigint) AS weight FROM units GROUP BY document_id, lower($PART(voice_id, '-', 2))), t AS (SELECT document_id, lang, weight, sum(weight) OVER (PARTITION BY document_id) AS total FROM v) SELECT document_id, lang FROM t WHERE weight * 100 >= 55 * total AND lang IN ('es', 'en', 'pt') AND weight > 0")
