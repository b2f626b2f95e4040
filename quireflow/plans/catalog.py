"""Declarative queries in the common subset of Spark SQL and DuckDB SQL.

A query is written once, over the driver's tables and the adapter views below; ``$`` words stand for the few
functions whose names differ. Catalyst plans the Spark form; the DuckDB form, run by another engine over the same
files, is the check of it. Only the views a query mentions are put before it, so pruning reaches the scans.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings manifest blocks page_candidates audiobook_units translation_units size_limits container_sizes source_targets").split()

# Function names, Spark and DuckDB.
WORDS = {
    "$LIKE(": ("regexp_like(", "regexp_matches("),
    "$R'": ("r'", "'"),
    "$G": ("", ", 'g'"),
    "$STR": ("string", "varchar"),
    "$SIZE(": ("size(", "len("),
    "$SHA(": ("sha2(", "sha256("),
    "$256": (", 256", ""),
    "$DIV": ("div", "//"),
    "$LIST(": ("collect_list(", "list("),
    "$SORT(": ("array_sort(", "list_sort("),
    "$AT(": ("element_at(", "list_extract("),
    "$EXPLODE(": ("explode(", "unnest("),
    "$SPLIT(": ("split(", "string_split_regex("),
    "$ARR(": ("array(", "list_value("),
    "$HAS(": ("array_contains(", "list_contains("),
    "$UNIQUE(": ("array_distinct(", "list_distinct("),
    "$CAT(": ("concat(", "list_concat("),
    "$SEQ(": ("sequence(", "generate_series("),
    "$BYTES(": ("octet_length(", "strlen("),
    "$JOIN(": ("array_join(", "array_to_string("),
    "$REV(": ("reverse(", "list_reverse("),
    "$HEX(": ("hex(", "hex("),
    "$PART(": ("split_part(", "split_part("),
    "$LOG(": ("ln(", "ln("),
}

# Adapter views: name -> (Spark, DuckDB). A single string serves both.
VIEWS: dict[str, tuple[str, str] | str] = {
    "lines": (
        "SELECT DISTINCT document_id, page_index, e.block_id, e.text, e.x, e.y, e.w, e.h, e.confidence FROM (SELECT document_id, page_index, explode(concat(coalesce(direct_blocks, array()), coalesce(ocr_blocks, array()))) AS e FROM page_candidates)",
        "SELECT DISTINCT document_id, page_index, e.block_id AS block_id, e.text AS text, e.x AS x, e.y AS y, e.w AS w, e.h AS h, e.confidence AS confidence FROM (SELECT document_id, page_index, unnest(list_concat(coalesce(direct_blocks, []), coalesce(ocr_blocks, []))) AS e FROM page_candidates) q",
    ),
    "candidates": "SELECT request_id, min(document_id) AS document_id, min(page_index) AS page_index, bool_or(raster_content_detected) AS raster, min(ocr_status) AS ocr_status, min(ocr_error_code) AS ocr_error_code, max(ocr_elapsed_ms) AS ocr_elapsed_ms, max(coalesce($SIZE(direct_blocks), 0)) AS n_direct, max(coalesce($SIZE(ocr_blocks), 0)) AS n_ocr FROM page_candidates GROUP BY request_id",
    "page_lines": "SELECT document_id, page_index, count(*) AS n, median(h) AS median_h, min(x) AS min_x, max(x + w) AS max_right, min(y) AS min_y, max(y + h) AS max_top FROM lines GROUP BY document_id, page_index",
    "units": "SELECT unit_id, min(job_id) AS job_id, min(document_id) AS document_id, min(unit_index) AS unit_index, min(anchor_id) AS anchor_id, min(voice_id) AS voice_id, min(text) AS text FROM audiobook_units GROUP BY unit_id",
    "tunits": "SELECT unit_id, min(request_id) AS request_id, min(unit_index) AS unit_index, min(source_language) AS source_language, min(target_language) AS target_language, min(text) AS text FROM translation_units GROUP BY unit_id",
    "entries": "SELECT document_id, min(entry_role) AS entry_role, min(file_path) AS file_path, min(sha256_hex) AS sha256_hex, max(byte_size) AS byte_size, min(layout) AS layout, min(content) AS content, min(language) AS language, bool_or(required) AS required, bool_or(distributable) AS distributable, max(page_count) AS page_count FROM manifest GROUP BY document_id",
    "truth": "SELECT block_id, min(document_id) AS document_id, min(page_index) AS page_index, min(block_order) AS block_order, min(text) AS text, min(degradation) AS degradation, min(revision) AS revision, min(confidence) AS confidence, min($AT(region, 1)) AS rx, min($AT(region, 2)) AS ry, min($AT(region, 3)) AS rw, min($AT(region, 4)) AS rh FROM blocks GROUP BY block_id",
    "segments": "SELECT l_orderkey AS unit_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS segment_index, l_linenumber AS declared, cast(floor(l_quantity * 1000) AS bigint) AS sample_count, CASE WHEN l_linenumber % 3 = 0 THEN 22050 ELSE 24000 END AS sample_rate_hz, cast(floor(l_extendedprice / 10) AS bigint) AS elapsed_ms FROM lineitem",
    "fragments": "SELECT o_custkey AS job, o_orderkey AS unit_id, cast(floor(o_totalprice) AS bigint) AS duration_ms, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
    "metrics": "SELECT user_id AS run_id, event_id, event_type AS name, cast(floor(value * 100) AS bigint) AS numerator, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, epoch_ms AS clock_ms FROM (SELECT *, {epoch} AS epoch_ms FROM events) q",
    # Boxes of real pages: the lines as a layout detector would see them, with a role by what they hold and where they stand.
    "rects": "SELECT block_id AS id, document_id, page_index, document_id || '#' || cast(page_index AS $STR) AS page, text, x, y, w, h, confidence, CASE WHEN coalesce(trim(text), '') = '' THEN 'unknown' WHEN $LIKE(trim(text), '^[0-9ivxlIVXL]{1,6}$') THEN 'number' WHEN y >= 760 THEN 'header' WHEN y <= 60 THEN 'footer' WHEN w < 120 THEN 'aside_text' ELSE 'text' END AS role FROM lines WHERE x IS NOT NULL AND y IS NOT NULL AND w > 0 AND h > 0",
    # Regions of the ground truth, as fractions of a page of 600 by 800 points from the top, in points from the bottom.
    "regions": "SELECT block_id AS id, document_id, page_index, document_id || '#' || cast(page_index AS $STR) AS page, block_order AS ord, rx * 600 AS x, (1 - ry - rh) * 800 AS y, rw * 600 AS w, rh * 800 AS h, confidence, CASE WHEN degradation = 'unreadable' THEN 'image' WHEN length(text) <= 60 THEN 'paragraph_title' ELSE 'text' END AS role FROM truth WHERE rx IS NOT NULL AND rw > 0 AND rh > 0 AND confidence IS NOT NULL AND NOT isnan(confidence)",
    # Column boundary of a page: the widest gap of 12 points or more that parts at least two lines from at least two.
    "gutters": "SELECT document_id, page_index, max_by(next_x, gap * 1000 + i) AS boundary FROM (SELECT document_id, page_index, next_x, next_x - left_edge AS gap, i FROM (SELECT document_id, page_index, max(x + w) OVER (PARTITION BY document_id, page_index ORDER BY x, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS left_edge, lead(x) OVER (PARTITION BY document_id, page_index ORDER BY x, block_id) AS next_x, row_number() OVER (PARTITION BY document_id, page_index ORDER BY x, block_id) AS i, count(*) OVER (PARTITION BY document_id, page_index) AS n FROM lines) o WHERE n >= 4 AND i >= 2 AND n - i >= 2 AND next_x - left_edge >= 12) g GROUP BY document_id, page_index",
    # Lines in reading order: column by column, each from the top.
    "ordered": "SELECT l.*, CASE WHEN l.x >= g.boundary THEN 1 ELSE 0 END AS col, row_number() OVER (PARTITION BY l.document_id, l.page_index ORDER BY CASE WHEN l.x >= g.boundary THEN 1 ELSE 0 END, l.y + l.h DESC, l.x, l.block_id) AS pos FROM lines l LEFT JOIN gutters g ON l.document_id = g.document_id AND l.page_index = g.page_index",
    "paragraphs": "SELECT block_id, document_id, page_index, block_order, text FROM truth WHERE degradation IS NULL AND text IS NOT NULL",
}
EPOCH = ("unix_millis(cast(ts AS timestamp))", "cast(epoch_ms(ts) AS bigint)")

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _count_if(text: str) -> str:
    """``count_if(c)`` as ``count(CASE WHEN c THEN 1 END)``, which counts in 64 bits in both engines."""
    while (i := text.find("count_if(")) >= 0:
        depth, j = 1, i + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            j += 1
        text = f"{text[:i]}count(CASE WHEN {text[i + 9 : j - 1]} THEN 1 END){text[j:]}"
    return text


def _doubles(text: str) -> str:
    """Decimal literals outside strings as doubles, so that both engines compute in the same type."""
    parts = text.split("'")
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1E0", parts[i])
    return "'".join(parts)


def _speak(text: str, dialect: int) -> str:
    text = _doubles(_count_if(text))
    for word, forms in WORDS.items():
        text = text.replace(word, forms[dialect])
    return text.replace("{epoch}", EPOCH[dialect])


def _view(name: str, dialect: int) -> str:
    v = VIEWS[name]
    return _speak(v if isinstance(v, str) else v[dialect], dialect)


def _mentioned(text: str) -> list[str]:
    """The views a text needs, those they need themselves first."""
    out: list[str] = []

    def visit(t: str) -> None:
        for name, v in VIEWS.items():
            if name not in out and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", t):
                visit(v if isinstance(v, str) else v[0])
                out.append(name)

    visit(text)
    return out


def render(text: str, dialect: int) -> str:
    views = _mentioned(text)
    body = _speak(text, dialect).strip()
    if not views:
        return body
    ctes = ",\n".join(f"{v} AS ({_view(v, dialect)})" for v in views)
    if re.match(r"WITH RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):].lstrip()}"
    if re.match(r"WITH\b", body, re.I):
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run Spark SQL with the tables it mentions as temporary views of ``sf_dir``."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def q(name: str, text: str, duck: str | None = None) -> None:
    """Register a query; ``duck`` only where the DuckDB form needs its own words."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    spark_sql = render(text, 0)
    QUERIES[name] = lambda spark, sf_dir, s=spark_sql: run_sql(spark, sf_dir, s)
    SQL[name] = render(duck or text, 1)


def oracle(name: str, duck: str) -> None:
    """The DuckDB form alone, of a query that ``pipeline`` builds from DataFrame operators."""
    SQL[name] = render(duck, 1)
