"""Page geometry: boxes of real pages, their columns, regions, headings, notes and furniture.

Every join is within a page, whose lines are bounded by what fits on paper, so the work grows with the pages.
Where a rule needs care, the DuckDB form is written apart from the Spark form.
"""

from .aggregates import nearest, upper_median
from .catalog import oracle, q

PG = "document_id, page_index"


def on(a: str, b: str) -> str:
    return f"{a}.document_id = {b}.document_id AND {a}.page_index = {b}.page_index"


# boxes ------------------------------------------------------------------------------------------------------------
HIT = "a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h"
INTER = "(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
q("fn_iou", f"SELECT a.id AS a, b.id AS b, round({INTER} / (a.w * a.h + b.w * b.h - {INTER}), 9) AS iou FROM rects a JOIN rects b ON {on('a', 'b')} AND a.id < b.id AND {HIT}")
q("fn_coverage", f"SELECT a.id AS a, b.id AS b, round({INTER} / (a.w * a.h), 9) AS coverage FROM rects a JOIN regions b ON {on('a', 'b')} AND {HIT}")
q("fn_full_image_rect", "SELECT id, page_index % 4 AS quarter, CASE page_index % 4 WHEN 1 THEN y / 800.0 WHEN 2 THEN 1 - (x + w) / 600.0 WHEN 3 THEN 1 - (y + h) / 800.0 ELSE x / 600.0 END AS fx, CASE page_index % 4 WHEN 1 THEN 1 - (x + w) / 600.0 WHEN 2 THEN 1 - (y + h) / 800.0 WHEN 3 THEN x / 600.0 ELSE y / 800.0 END AS fy, CASE WHEN page_index % 2 = 1 THEN h / 800.0 ELSE w / 600.0 END AS fw, CASE WHEN page_index % 2 = 1 THEN w / 600.0 ELSE h / 800.0 END AS fh FROM rects")
q("fn_render_size", "SELECT id, CASE WHEN page_index % 2 = 1 THEN h ELSE w END AS render_w, CASE WHEN page_index % 2 = 1 THEN w ELSE h END AS render_h FROM rects")
q("prd_rotated_layout_rects", "SELECT id, page_index % 4 AS quarter, CASE page_index % 4 WHEN 1 THEN 800 - y - h WHEN 2 THEN 600 - x - w WHEN 3 THEN y ELSE x END AS px, CASE page_index % 4 WHEN 1 THEN x WHEN 2 THEN 800 - y - h WHEN 3 THEN 600 - x - w ELSE y END AS py FROM rects")
q("prd_layout_usable", "SELECT id, role <> 'unknown' AND coalesce(confidence, 0) >= 0.30 AND NOT isnan(coalesce(confidence, 0)) AS usable FROM rects")
q("srt_top300", "SELECT id, page, rk FROM (SELECT id, page, row_number() OVER (PARTITION BY page ORDER BY confidence DESC, id) AS rk FROM rects WHERE confidence >= 0.3) t WHERE rk <= 300")
q("prj_detections", "SELECT page, id, x - w / 2.0 AS x1, y - h / 2.0 AS y1, x + w / 2.0 AS x2, y + h / 2.0 AS y2, rk FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY confidence DESC, id) AS rk FROM rects WHERE confidence >= 0.3) t WHERE rk <= 300")
q(
    "agg_layout_role",
    "WITH g AS (SELECT page, role, max(confidence) AS top, min(CASE role WHEN 'header' THEN 1 WHEN 'footer' THEN 2 WHEN 'number' THEN 3 WHEN 'text' THEN 4 ELSE 5 END) AS place FROM rects WHERE role <> 'unknown' AND confidence >= 0.30 AND NOT isnan(confidence) GROUP BY page, role) SELECT page, role, top FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY top DESC, place) AS rk, lead(top) OVER (PARTITION BY page ORDER BY top DESC, place) AS second FROM g) t WHERE rk = 1 AND (second IS NULL OR top >= second + 0.10)",
    "SELECT a.page, a.role, a.top FROM (SELECT page, role, max(confidence) AS top FROM rects WHERE role <> 'unknown' AND confidence >= 0.30 AND NOT isnan(confidence) GROUP BY page, role) a WHERE NOT EXISTS (SELECT 1 FROM rects b WHERE b.page = a.page AND b.role <> a.role AND b.role <> 'unknown' AND b.confidence >= 0.30 AND NOT isnan(b.confidence) AND NOT a.top >= b.confidence + 0.10)",
)
oracle("agg_order_votes", "SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY votes, id) AS rk FROM (SELECT a.page, a.id, round(sum(CASE WHEN a.id = b.id THEN 0 ELSE 1 / (1 + exp(-(a.y - b.y) / 100.0)) END), 6) AS votes FROM rects a JOIN rects b ON a.page = b.page GROUP BY a.page, a.id) t")
oracle("prj_spread_regions", "SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN x >= 200 THEN 1 ELSE 0 END, y, x, id) - 1 AS ord FROM rects QUALIFY count_if(x >= 200) OVER (PARTITION BY page) > 0 AND count_if(x < 200) OVER (PARTITION BY page) > 0")

# regions on lines -------------------------------------------------------------------------------------------------
ATTACHED = f"""WITH o AS (SELECT a.id, a.document_id, a.page_index, a.y AS top_y, b.id AS region, b.ord, b.role, b.confidence, {INTER} / (a.w * a.h) AS coverage FROM rects a JOIN regions b ON {on('a', 'b')} AND b.role <> 'image' AND b.confidence >= 0.30 AND {HIT}),
f AS (SELECT *, row_number() OVER w AS rk, first_value(role) OVER w AS brole, first_value(coverage) OVER w AS bcov, first_value(confidence) OVER w AS bconf FROM o WHERE coverage >= 0.60 WINDOW w AS (PARTITION BY id ORDER BY coverage DESC, confidence DESC, region)),
v AS (SELECT *, max(CASE WHEN role <> brole AND bcov - coverage <= 0.02 AND bconf - confidence <= 0.02 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS veto FROM f),
att AS (SELECT id, document_id, page_index, region, ord, role FROM v WHERE rk = 1 AND veto = 0)
"""
q("join_layout_overlap", ATTACHED + "SELECT id AS block, region, role FROM att")
MATCHED = ", s AS (SELECT r.document_id, r.page_index, count(att.id) AS matched, count(*) AS blocks FROM rects r LEFT JOIN att ON att.id = r.id WHERE r.role <> 'unknown' GROUP BY r.document_id, r.page_index)\n"
q("agg_layout_coverage", ATTACHED + MATCHED + "SELECT document_id, page_index, matched, blocks, matched * 100 >= 60 * blocks AS layout_mode FROM s")
q("join_layout_enrich", ATTACHED + MATCHED + f"SELECT r.id AS block, att.region, att.role, row_number() OVER (PARTITION BY r.document_id, r.page_index ORDER BY coalesce(att.ord, 1000000), d.pos) AS pos FROM rects r JOIN s ON {on('r', 's')} AND s.matched * 100 >= 60 * s.blocks JOIN ordered d ON d.block_id = r.id LEFT JOIN att ON att.id = r.id")
q("win_layout_order", ATTACHED + f", m AS (SELECT {PG}, {upper_median('h')} AS mh FROM rects GROUP BY {PG}) SELECT r.id, row_number() OVER (PARTITION BY r.document_id, r.page_index ORDER BY coalesce(att.ord, 1000000), CASE WHEN length(trim(r.text)) = 1 AND r.h >= 2 * m.mh THEN 0 ELSE 1 END, r.y + r.h DESC, r.x, r.id) AS pos FROM rects r JOIN m ON {on('r', 'm')} LEFT JOIN att ON att.id = r.id")
q("prd_same_layout_region", ATTACHED + "SELECT id, coalesce(ord = lag(ord) OVER w AND role = lag(role) OVER w, false) AS same_region FROM (SELECT att.*, d.pos FROM att JOIN ordered d ON d.block_id = att.id) t WINDOW w AS (PARTITION BY document_id, page_index ORDER BY pos)")
q("agg_layout_report", ATTACHED + f", p AS (SELECT g.document_id, g.page_index, count(DISTINCT att.region) * 1.0 / count(DISTINCT g.id) AS recall FROM regions g LEFT JOIN att ON att.region = g.id GROUP BY g.document_id, g.page_index) SELECT round(min(p.recall), 9) AS min_recall, cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY c.ocr_elapsed_ms DESC) AS bigint) AS median_ms, bool_and(coalesce(c.ocr_elapsed_ms, 0) >= 0) AS all_finite FROM p JOIN candidates c ON {on('p', 'c')}")
q(
    "join_spread_nearest",
    f"WITH h AS (SELECT {PG}, CASE WHEN x + w / 2 < 200 THEN 0 ELSE 1 END AS half, min(x) AS x0, max(x + w) AS x1, min(y) AS y0, max(y + h) AS y1 FROM rects WHERE role = 'text' GROUP BY {PG}, CASE WHEN x + w / 2 < 200 THEN 0 ELSE 1 END), d AS (SELECT r.id, h.half, power(greatest(h.x0 - (r.x + r.w / 2), 0, r.x + r.w / 2 - h.x1), 2) + power(greatest(h.y0 - (r.y + r.h / 2), 0, r.y + r.h / 2 - h.y1), 2) AS dist FROM rects r JOIN h ON {on('r', 'h')}) SELECT id, half FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, half) AS rk FROM d) t WHERE rk = 1",
)
CLICK = "(SELECT id AS click, document_id, page_index, x + w * 0.3 AS px, y + h * 0.1 AS py FROM regions)"
q(
    "join_point_in_rect",
    f"WITH d AS (SELECT c.click, o.block_id, o.pos, c.px BETWEEN o.x AND o.x + o.w AND c.py BETWEEN o.y AND o.y + o.h AS inside, abs(c.py - (o.y + o.h / 2)) AS far FROM {CLICK} c JOIN ordered o ON {on('c', 'o')}) SELECT click, block_id AS unit, inside FROM (SELECT *, row_number() OVER (PARTITION BY click ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN 0.0 ELSE far END, pos) AS rk FROM d) t WHERE rk = 1",
    f"SELECT click, coalesce(hit, near_) AS unit, hit IS NOT NULL AS inside FROM (SELECT c.click, min_by(o.block_id, o.pos) FILTER (WHERE c.px >= o.x AND c.px <= o.x + o.w AND c.py >= o.y AND c.py <= o.y + o.h) AS hit, min_by(o.block_id, struct_pack(a := abs(c.py - (o.y + o.h / 2)), b := o.pos)) AS near_ FROM {CLICK} c JOIN ordered o ON {on('c', 'o')} GROUP BY c.click) t",
)
q("prd_physical_spread", f"WITH p AS (SELECT {PG}, (max(x + w) + min(x)) AS wide, max(y + h) AS high FROM rects GROUP BY {PG}) SELECT r.document_id, r.page_index, max(p.wide / p.high) >= 1.15 AND count_if(r.role IN ('text', 'aside_text') AND r.confidence >= 0.3 AND r.x + r.w < p.wide * 0.46) > 0 AND count_if(r.role IN ('text', 'aside_text') AND r.confidence >= 0.3 AND r.x > p.wide * 0.54) > 0 AND count_if(r.role IN ('text', 'aside_text') AND r.confidence >= 0.3 AND r.x < p.wide * 0.54 AND r.x + r.w > p.wide * 0.46) = 0 AND count_if(r.role IN ('number', 'footer') AND r.y + r.h / 2 <= p.high * 0.2 AND r.x + r.w / 2 < p.wide * 0.46) > 0 AND count_if(r.role IN ('number', 'footer') AND r.y + r.h / 2 <= p.high * 0.2 AND r.x + r.w / 2 > p.wide * 0.54) > 0 AS spread FROM rects r JOIN p ON {on('r', 'p')} GROUP BY r.document_id, r.page_index")
q("prd_ocr_split", f"SELECT c.document_id, c.page_index, c.ocr_status = 'completed' AND coalesce(g.sides, 0) = 2 AND coalesce(g.n, 0) > 0 AS split FROM candidates c LEFT JOIN (SELECT {PG}, count(*) AS n, count(DISTINCT CASE WHEN x + w < 276 THEN 0 WHEN x > 324 THEN 1 END) AS sides FROM regions GROUP BY {PG}) g ON {on('c', 'g')} WHERE c.ocr_status IS NOT NULL")

# columns ----------------------------------------------------------------------------------------------------------
q("win_column_split", "SELECT document_id, page_index, boundary FROM gutters")
q("win_top_down_order", "SELECT block_id, document_id, page_index, pos FROM ordered")
q("agg_page_metrics", f"SELECT document_id, page_index, col, {upper_median('h')} AS median_h, {nearest('h', 0.75)} AS p75_h, {nearest('x', 0.1)} AS p10_left, {nearest('x + w', 0.9)} AS p90_right FROM ordered WHERE w > 0 AND h > 0 AND x IS NOT NULL AND confidence >= 0.6 GROUP BY document_id, page_index, col")
MH = f"(SELECT {PG}, {upper_median('h')} AS mh, min(y) AS floor_, max(y + h) AS ceiling_ FROM lines WHERE h IS NOT NULL AND y IS NOT NULL GROUP BY {PG})"
SAME = "abs(y + h / 2 - pcy) < 0.5 * mh AND x - (px + pw) BETWEEN -0.5 * mh AND mh"
NEXT = f"(SELECT o.document_id, o.page_index, o.block_id, o.text, o.x, o.y, o.w, o.h, o.confidence, o.col, o.pos, m.mh, m.floor_, m.ceiling_, lag(o.y + o.h / 2) OVER w AS pcy, lag(o.h) OVER w AS ph, lag(o.x) OVER w AS px, lag(o.w) OVER w AS pw, lag(o.y) OVER w AS py, lead(o.y) OVER w AS ny FROM ordered o JOIN {MH} m ON {on('o', 'm')} WINDOW w AS (PARTITION BY o.document_id, o.page_index ORDER BY o.pos))"
q("win_visual_line_merge", f"SELECT document_id, page_index, cast(line_no AS bigint) AS line_no, count(*) AS blocks FROM (SELECT document_id, page_index, sum(CASE WHEN coalesce({SAME}, false) THEN 0 ELSE 1 END) OVER (PARTITION BY document_id, page_index ORDER BY pos) AS line_no FROM {NEXT} n) t GROUP BY document_id, page_index, line_no")
q("prd_inline_punct", f"SELECT n.block_id, coalesce(NOT $LIKE(n.text, $R'[\\p{{L}}\\p{{N}}]') AND r.role NOT IN ('header', 'footer', 'number') AND {SAME.replace('y +', 'n.y +').replace('h / 2', 'n.h / 2').replace('AND x ', 'AND n.x ')}, false) AS inline_punct FROM {NEXT} n JOIN rects r ON r.id = n.block_id WHERE n.text IS NOT NULL")
q("prd_drop_cap", f"SELECT n.block_id AS cap, l.block_id AS line FROM {NEXT} n JOIN lines l ON {on('n', 'l')} AND l.block_id <> n.block_id AND n.x + n.w <= l.x AND n.y < l.y + l.h AND l.y < n.y + n.h WHERE $LIKE(trim(n.text), $R'^\\p{{L}}$') AND n.h >= 2 * n.mh")
WORDS = "$SIZE($SPLIT(trim(text), $R'\\s+'))"
q("win_heading_isolation", f"SELECT block_id, coalesce({WORDS} BETWEEN 1 AND 12 AND NOT $LIKE(trim(text), '[.,;:]$') AND $LIKE(trim(text), $R'^[^\\p{{L}}]*\\p{{Lu}}') AND (h >= 1.35 * mh OR (h >= 1.2 * mh AND coalesce(py - (y + h) > 2.4 * mh, true) AND coalesce(y - ny > 2.4 * mh, true))), false) AS isolated FROM {NEXT} n WHERE text IS NOT NULL")
NOTE = "$LIKE(trim(text), $R'^[0-9]{1,3}([.)\\]](\\s|$)|\\s\\p{Lu})') AND NOT $LIKE(text, $R'\\.{3,}\\s*[0-9]+\\s*$') AND confidence >= 0.6 AND h <= 1.25 * mh AND y + h <= floor_ + (ceiling_ - floor_) * 0.25 AND max(y) OVER (PARTITION BY document_id, page_index) > floor_ + (ceiling_ - floor_) * 0.25"
q("win_footnote_zone", f"SELECT block_id, coalesce(pos >= min(CASE WHEN note THEN pos END) OVER (PARTITION BY document_id, page_index, col), false) AS in_zone FROM (SELECT document_id, page_index, block_id, col, pos, {NOTE} AS note FROM {NEXT} n WHERE text IS NOT NULL) t")

# callouts ---------------------------------------------------------------------------------------------------------
# A numeral of one to three digits attached to a letter or closing mark, nothing alphanumeric after it. What stands
# after one may stand before the next, so it is doubled before the search.
ATT = "regexp_extract_all(regexp_replace({t}, $R'([0-9])([^\\p{L}\\p{N}.])', $12${R}2$G), $R'(?:[\\p{L})\\]]|[^0-9]\\.)([0-9]{1,3})(?:[^\\p{L}\\p{N}]|$)', 1)"


def att(text: str, dialect: int) -> str:
    return ATT.replace("{t}", text).replace("$12${R}2", ("'$1$2$2'", "'\\1\\2\\2'")[dialect])


def both(name: str, make) -> None:
    q(name, make(0), make(1))


both("fn_attached_callouts", lambda k: f"SELECT block_id, $JOIN({att('text', k)}, ',') AS callouts FROM truth WHERE text IS NOT NULL")
NUMERALS = f"SELECT DISTINCT {PG}, regexp_extract(trim(text), '^([0-9]{{1,3}})[.)]', 1) AS numeral FROM lines WHERE $LIKE(trim(text), '^[0-9]{{1,3}}[.)]')"
both("join_callout_semi", lambda k: f"WITH n AS ({NUMERALS}), c AS (SELECT DISTINCT document_id, page_index, block_id, $EXPLODE({att('text', k)}) AS numeral FROM lines WHERE text IS NOT NULL) SELECT DISTINCT c.block_id FROM c WHERE EXISTS (SELECT 1 FROM n WHERE {on('n', 'c')} AND n.numeral = c.numeral)")
both("fn_contains_callout", lambda k: f"WITH n AS ({NUMERALS}) SELECT t.block_id, n.numeral, $HAS({att('t.text', k)}, n.numeral) AS has_callout FROM (SELECT * FROM truth WHERE text IS NOT NULL) t JOIN n ON {on('n', 't')}")
LEADING = f"SELECT document_id, page_index, regexp_extract(trim(text), $R'^([0-9]{{1,3}})\\s', 1) AS numeral FROM {NEXT} n WHERE $LIKE(trim(text), $R'^[0-9]{{1,3}}\\s') AND coalesce(confidence, 0) >= 0.6 AND abs(y + h / 2 - pcy) < 0.5 * greatest(h, ph) AND x - (px + pw) BETWEEN -0.5 * ph AND ph"
both("win_inferred_endnotes", lambda k: f"SELECT document_id, page_index, count(DISTINCT v) AS notes, min(v) AS first_note, max(v) AS last_note FROM (SELECT document_id, page_index, cast(numeral AS int) AS v FROM (SELECT document_id, page_index, $EXPLODE({att('text', k)}) AS numeral FROM lines WHERE text IS NOT NULL UNION ALL {LEADING}) e) t GROUP BY document_id, page_index HAVING count(DISTINCT v) >= 3 AND max(v) - min(v) <= count(DISTINCT v) + 1")
both("fn_omit_callouts", lambda k: f"WITH n AS (SELECT document_id, page_index, $JOIN($SORT($LIST(numeral)), '|') AS listed FROM ({NUMERALS}) z GROUP BY document_id, page_index) SELECT t.block_id, CASE WHEN n.listed IS NULL THEN t.text ELSE regexp_replace(t.text, $R'([\\p{{L}})\\]]|[^0-9]\\.)(' || n.listed || $R')([^\\p{{L}}\\p{{N}}]|$)', {('$1$3', chr(92) + '1' + chr(92) + '3')[k].join(chr(39) * 2)}$G) END AS spoken FROM (SELECT * FROM truth WHERE text IS NOT NULL) t LEFT JOIN n ON {on('n', 't')}")

# headings and outline ---------------------------------------------------------------------------------------------
HEADING = f"({WORDS} BETWEEN 1 AND 30 AND NOT $LIKE(trim(text), '[.,]$') AND length(regexp_replace(text, $R'[^\\p{{L}}]', ''$G)) >= 3 AND length(regexp_replace(text, $R'[^\\p{{L}} ]', ''$G)) * 100 >= length(text) * 75)"
FROM_, TO = "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"
FOLD = f"translate(lower(regexp_replace(trim(text), $R'\\s+', ' '$G)), '{FROM_}', '{TO}')"
q("prd_heading_candidate", f"SELECT block_id, {HEADING} AS heading FROM paragraphs")
q("prd_outline_readable", f"SELECT document_id, avg(CASE WHEN $LIKE(text, $R'\\p{{L}}{{3}}') THEN 1.0 ELSE 0.0 END) >= 0.5 AS readable FROM paragraphs WHERE {HEADING} GROUP BY document_id")
q("agg_title_repeat", f"SELECT document_id, {FOLD} AS title, count(DISTINCT page_index) AS pages FROM lines WHERE text IS NOT NULL AND {HEADING} GROUP BY document_id, {FOLD} HAVING count(DISTINCT page_index) >= 3")
q("agg_outline_cap", f"SELECT p.document_id, coalesce(h.titles, 0) AS titles, coalesce(h.titles, 0) <= greatest(4, p.pages * 3 $DIV 5) AS kept FROM (SELECT document_id, count(DISTINCT page_index) AS pages FROM paragraphs GROUP BY document_id) p LEFT JOIN (SELECT document_id, count(*) AS titles FROM paragraphs WHERE {HEADING} GROUP BY document_id) h ON h.document_id = p.document_id")
q("prd_title_reordering", f"WITH t AS (SELECT DISTINCT document_id, {FOLD} AS title, $JOIN($SORT($SPLIT({FOLD}, ' ')), ' ') AS bag FROM paragraphs WHERE {HEADING}) SELECT document_id, bag, count(*) AS orders, min(title) AS title FROM t GROUP BY document_id, bag HAVING count(*) >= 2")
q("win_prescan_headings", f"SELECT document_id, page_index, cast(run AS bigint) AS run, min(pos) AS first_pos, count_if($LIKE(text, $R'\\p{{L}}')) AS parts, CASE WHEN max(CASE WHEN run_start = 1 THEN h / mh END) >= 2.5 THEN 0 ELSE 1 END AS level FROM (SELECT *, sum(run_start) OVER (PARTITION BY document_id, page_index ORDER BY pos) AS run FROM (SELECT *, CASE WHEN big AND NOT coalesce(lag(big) OVER (PARTITION BY document_id, page_index ORDER BY pos), false) THEN 1 ELSE 0 END AS run_start FROM (SELECT document_id, page_index, block_id, text, h, mh, pos, h >= 1.2 * mh AND $LIKE(text, $R'\\p{{L}}') OR NOT $LIKE(text, $R'\\p{{L}}') AS big FROM {NEXT} n WHERE text IS NOT NULL) a) b) t WHERE big AND run > 0 GROUP BY document_id, page_index, run HAVING count_if($LIKE(text, $R'\\p{{L}}')) > 0".replace("h >= 1.2 * mh", "h >= 1.35 * mh"))
LETTERS = "length(regexp_replace({c}, $R'[^\\p{L}]', ''$G))"
q("join_outline_titles", f"WITH p AS (SELECT document_id, page_index, min_by(text, block_order) AS title FROM paragraphs WHERE {HEADING} GROUP BY document_id, page_index), o AS (SELECT document_id, page_index, min_by(text, pos) AS heading FROM ordered WHERE text IS NOT NULL AND block_id LIKE '%-ocr-%' AND {HEADING} GROUP BY document_id, page_index), j AS (SELECT p.document_id, p.page_index, p.title, o.heading, $JOIN($SORT($SPLIT({FOLD.replace('text', 'p.title')}, ' ')), ' ') AS a, $JOIN($SORT($SPLIT({FOLD.replace('text', 'o.heading')}, ' ')), ' ') AS b FROM p LEFT JOIN o ON {on('p', 'o')}) SELECT document_id, page_index, CASE WHEN heading IS NOT NULL AND {LETTERS.replace('{c}', 'heading')} >= {LETTERS.replace('{c}', 'title')} AND NOT (a = b AND heading <> title) THEN heading ELSE title END AS title FROM j")
q("win_hyphen_continuation", f"SELECT block_id, coalesce(ends AND $LIKE(nxt, $R'^\\p{{Ll}}') AND ncol = col AND cy - ncy <= 2.1 * mh, false) AS merges FROM (SELECT block_id, col, mh, y + h / 2 AS cy, $LIKE(text, $R'\\p{{L}}-$') AS ends, lead(text) OVER w AS nxt, lead(col) OVER w AS ncol, lead(y + h / 2) OVER w AS ncy FROM {NEXT} n WHERE text IS NOT NULL WINDOW w AS (PARTITION BY document_id, page_index ORDER BY pos)) t")
ASOF = f"""WITH e AS (SELECT document_id, page_index, CASE WHEN {HEADING} THEN 0 ELSE 1 END AS kind, min(block_order) AS ord FROM paragraphs GROUP BY document_id, page_index, CASE WHEN {HEADING} THEN 0 ELSE 1 END)"""
q(
    "join_chapter_asof",
    ASOF + ", a AS (SELECT document_id, page_index, kind, min(CASE WHEN kind = 1 THEN page_index END) OVER (PARTITION BY document_id ORDER BY page_index RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit_page FROM e), b AS (SELECT document_id, page_index, unit_page, max(unit_page) OVER (PARTITION BY document_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM a WHERE kind = 0), c AS (SELECT *, unit_page IS NOT NULL AND (best IS NULL OR unit_page > best) AS accepted FROM b) SELECT document_id, page_index AS entry_page, unit_page FROM (SELECT *, count_if(accepted) OVER (PARTITION BY document_id) AS n, count(*) OVER (PARTITION BY document_id) AS entries FROM c) t WHERE accepted AND n * 10 >= 6 * entries",
    ASOF + ", u AS (SELECT o.document_id, o.page_index AS entry_page, min(x.page_index) AS unit_page FROM e o LEFT JOIN e x ON x.document_id = o.document_id AND x.kind = 1 AND x.page_index >= o.page_index WHERE o.kind = 0 GROUP BY o.document_id, o.page_index), f AS (SELECT document_id, unit_page, min(entry_page) AS entry_page FROM u WHERE unit_page IS NOT NULL GROUP BY document_id, unit_page), s AS (SELECT document_id, count(*) AS entries, count(DISTINCT unit_page) AS n FROM u GROUP BY document_id) SELECT f.document_id, f.entry_page, f.unit_page FROM f JOIN s ON s.document_id = f.document_id WHERE s.n >= 0.6 * s.entries",
)

# sentences --------------------------------------------------------------------------------------------------------
SENT = "SELECT {e} FROM (SELECT block_id, document_id, page_index, block_order, {s} AS ss FROM paragraphs) p"
SPARK_SENT = SENT.format(e="block_id, document_id, page_index, block_order, posexplode(ss) AS (i, sentence)", s="split(regexp_replace(trim(text), r'([.!?…])\\s+', concat('$1', chr(30))), chr(30))")
DUCK_SENT = SENT.format(e="block_id, document_id, page_index, block_order, unnest(generate_series(0, len(ss) - 1)) AS i, unnest(ss) AS sentence", s="string_split(regexp_replace(trim(text), '([.!?…])\\s+', '\\1' || chr(30), 'g'), chr(30))")
UNIT = "SELECT block_id || '-' || cast(i AS $STR) AS unit_id, block_id AS parent_unit_id, 'sentence' AS kind, cast(i AS bigint) AS sentence_no, sentence FROM ({s}) z"
q("prj_sentence_unit", UNIT.format(s=SPARK_SENT), UNIT.format(s=DUCK_SENT))
ORD = "SELECT block_id, cast(i AS bigint) AS sentence_no, row_number() OVER (PARTITION BY document_id, page_index ORDER BY block_order, block_id, i) - 1 AS ordinal FROM ({s}) z"
q("win_sentence_ordinal", ORD.format(s=SPARK_SENT), ORD.format(s=DUCK_SENT))
q("win_narration_batch", "SELECT document_id, page_index, block_id, (row_number() OVER (PARTITION BY document_id, page_index ORDER BY block_order, block_id) - 1) $DIV 3 AS batch, dense_rank() OVER (PARTITION BY document_id ORDER BY page_index) AS page_turn FROM paragraphs WHERE trim(text) <> ''")

# samples ----------------------------------------------------------------------------------------------------------
q("srt_spread_sample", "SELECT document_id, page_count, i * page_count $DIV least(8, page_count) AS page_index FROM (SELECT document_id, page_count, $EXPLODE($SEQ(0, least(8, page_count) - 1)) AS i FROM entries WHERE page_count > 0) t")
q("srt_furniture_sample", "SELECT DISTINCT document_id, page_index FROM (SELECT document_id, page_count, k * ((page_count + 1) $DIV 2) $DIV 4 * 2 + side AS page_index FROM (SELECT document_id, page_count, k, $EXPLODE($SEQ(0, 1)) AS side FROM (SELECT document_id, page_count, $EXPLODE($SEQ(0, 3)) AS k FROM entries WHERE page_count > 0) a) b) t WHERE page_index < page_count")
EDGES = f"(SELECT document_id, page_index, regexp_replace(regexp_replace(trim(text), $R'\\s+', ' '$G), '[0-9]+', '#'$G) AS template FROM (SELECT *, row_number() OVER (PARTITION BY {PG} ORDER BY y DESC, x, block_id) AS i, row_number() OVER (PARTITION BY {PG} ORDER BY y, x, block_id) AS j FROM lines WHERE text IS NOT NULL AND trim(text) <> '') t WHERE i <= 2 OR j <= 2)"
q("st_furniture_prime", f"WITH n AS (SELECT document_id, page_index, row_number() OVER (PARTITION BY document_id ORDER BY page_index) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS n FROM (SELECT DISTINCT {PG} FROM lines) d), s AS (SELECT document_id, page_index FROM n WHERE n <= 64 OR i = 0 OR i * 64 $DIV n > (i - 1) * 64 $DIV n) SELECT e.document_id, e.template, count(DISTINCT e.page_index) AS seen FROM {EDGES} e JOIN s ON {on('e', 's')} GROUP BY e.document_id, e.template")
q("st_furniture_lru", "SELECT document_id, first_seen FROM (SELECT document_id, min(request_id) AS first_seen FROM candidates GROUP BY document_id) a ORDER BY first_seen DESC, document_id DESC LIMIT 4")
