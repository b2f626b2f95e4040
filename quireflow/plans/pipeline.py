"""Queries built from the DataFrame operators, each with an oracle where SQL can state it."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prosody
from ..functions.native import stable_id
from ..operators import furniture, matching, normalise, paragraphs, quality, sessions
from ..operators.arrow import map_rows
from ..runtime import checkpoint_dir, cut, spread, table
from ..sources import files
from ..streaming import windows as streams
from . import catalog
from .windows import EDGE

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = catalog.render(sql, 1)
        return fn

    return add


def view(spark, sf_dir: str, name: str) -> DataFrame:
    return catalog.run_sql(spark, sf_dir, catalog.render(f"SELECT * FROM {name}", 0))


FURNITURE = f"""WITH edge AS (SELECT document_id, page_index, block_id, max(CASE WHEN edge = 'top' THEN 1 ELSE 0 END) = 1 AS top FROM ({EDGE.replace('FROM lines WHERE h IS NOT NULL', 'FROM lines WHERE h IS NOT NULL AND text IS NOT NULL').replace('WHERE l.h IS NOT NULL', 'WHERE l.h IS NOT NULL AND l.text IS NOT NULL')}) z GROUP BY document_id, page_index, block_id),
span AS (SELECT document_id, page_index, max(x + w) - min(x) AS span FROM lines WHERE h IS NOT NULL AND text IS NOT NULL GROUP BY document_id, page_index),
e AS (SELECT d.document_id, d.page_index, d.block_id, d.top, trim(regexp_replace(l.text, $R'\\s+', ' '$G)) AS literal, regexp_replace(trim(regexp_replace(l.text, $R'\\s+', ' '$G)), '[0-9]+', '#'$G) AS template, l.w * 100 <= 75 * s.span AS narrow FROM edge d JOIN lines l ON l.document_id = d.document_id AND l.page_index = d.page_index AND l.block_id = d.block_id AND l.text IS NOT NULL JOIN span s ON s.document_id = d.document_id AND s.page_index = d.page_index WHERE trim(l.text) <> ''),
el AS (SELECT document_id, count(DISTINCT page_index) AS n, count(DISTINCT CASE WHEN page_index % 2 = 0 THEN page_index END) AS n0, count(DISTINCT CASE WHEN page_index % 2 = 1 THEN page_index END) AS n1 FROM e GROUP BY document_id),
t AS (SELECT e.document_id, template, count(DISTINCT page_index) AS s, count(DISTINCT CASE WHEN page_index % 2 = 0 THEN page_index END) AS s0, count(DISTINCT CASE WHEN page_index % 2 = 1 THEN page_index END) AS s1, count(CASE WHEN top THEN 1 END) AS heads, count(CASE WHEN NOT top THEN 1 END) AS foots, count(CASE WHEN narrow THEN 1 END) AS nar, count(CASE WHEN NOT narrow THEN 1 END) AS wid, max(el.n) AS n, max(el.n0) AS n0, max(el.n1) AS n1 FROM e JOIN el ON e.document_id = el.document_id GROUP BY e.document_id, template),
x AS (SELECT e.document_id, template, literal, count(DISTINCT page_index) AS s, count(DISTINCT CASE WHEN page_index % 2 = 0 THEN page_index END) AS s0, count(DISTINCT CASE WHEN page_index % 2 = 1 THEN page_index END) AS s1, max(el.n) AS n, max(el.n0) AS n0, max(el.n1) AS n1 FROM e JOIN el ON e.document_id = el.document_id GROUP BY e.document_id, template, literal),
qt AS (SELECT *, (template LIKE '%#%' AND s >= 3 AND (5 * s >= 3 * n OR (s0 >= 3 AND 5 * s0 >= 3 * n0) OR (s1 >= 3 AND 5 * s1 >= 3 * n1)) AND length(template) <= 120 AND nar >= wid) OR (template NOT LIKE '%#%' AND ((s >= 2 AND s = n) OR (s >= 3 AND (5 * s >= 3 * n OR (s0 >= 3 AND 5 * s0 >= 3 * n0) OR (s1 >= 3 AND 5 * s1 >= 3 * n1))))) AS q, CASE WHEN foots >= heads THEN 'remove_repeated_footer' ELSE 'remove_repeated_header' END AS rule FROM t),
qx AS (SELECT document_id, template, literal FROM x WHERE s >= 3 AND (5 * s >= 3 * n OR (s0 >= 3 AND 5 * s0 >= 3 * n0) OR (s1 >= 3 AND 5 * s1 >= 3 * n1)))
SELECT DISTINCT e.document_id, e.page_index, e.block_id, qt.rule FROM e JOIN qt ON e.document_id = qt.document_id AND e.template = qt.template LEFT JOIN qx ON e.document_id = qx.document_id AND e.template = qx.template AND e.literal = qx.literal WHERE qt.q OR qx.literal IS NOT NULL"""


@query("join_furniture_semi", FURNITURE)
def join_furniture_semi(spark, d):
    return furniture.removed(view(spark, d, "lines"))


EDGES = FURNITURE[: FURNITURE.index(",\nel AS")]


@query("agg_furniture_tally", EDGES + " SELECT document_id, template, count(DISTINCT page_index) AS pages, count(CASE WHEN top THEN 1 END) AS headers, count(CASE WHEN NOT top THEN 1 END) AS footers, count(CASE WHEN narrow THEN 1 END) AS narrow, count(CASE WHEN NOT narrow THEN 1 END) AS wide FROM e GROUP BY document_id, template")
def agg_furniture_tally(spark, d):
    return furniture.tally(furniture.edge_lines(view(spark, d, "lines")), "document_id", "template")


@query("agg_furniture_exact", EDGES + " SELECT document_id, template, literal, count(DISTINCT page_index) AS pages FROM e GROUP BY document_id, template, literal")
def agg_furniture_exact(spark, d):
    return furniture.tally(furniture.edge_lines(view(spark, d, "lines")), "document_id", "template", "literal").select("document_id", "template", "literal", "pages")


@query("join_furniture_edge", EDGES + ", k AS (SELECT document_id, literal FROM e GROUP BY document_id, literal HAVING count(DISTINCT page_index) >= 3) SELECT DISTINCT e.block_id FROM e JOIN k ON k.document_id = e.document_id AND k.literal = e.literal")
def join_furniture_edge(spark, d):
    """Edge lines whose text stands at the edge of three pages or more of the document."""
    edges = cut(furniture.edge_lines(view(spark, d, "lines")))
    known = edges.select("document_id", "literal", "page_index").distinct().groupBy("document_id", "literal").count().where("count >= 3")
    return edges.join(known, ["document_id", "literal"], "left_semi").select("block_id").distinct()


@query("join_furniture_anti", f"SELECT document_id, page_index, block_id FROM lines EXCEPT SELECT document_id, page_index, block_id FROM ({FURNITURE}) f".replace("FROM (WITH", "FROM (WITH"))
def join_furniture_anti(spark, d):
    return furniture.kept(view(spark, d, "lines")).select("document_id", "page_index", "block_id").distinct()


@query("agg_furniture_qualify")
def agg_furniture_qualify(spark, d):
    return furniture.qualified(furniture.edge_lines(view(spark, d, "lines")))


def _quality_pages(spark, d):
    docs = spread(table(spark, d, "documents").where("text IS NOT NULL").selectExpr("doc_id", "text", "lang AS language"))
    return quality.degradation(quality.counters(docs))


QUALITY = (
    """WITH t AS (SELECT doc_id, text, lower(trim(lang)) AS lang, list_filter(string_split_regex(text, '[^\\p{L}\\p{N}''’-]+'), lambda w: regexp_matches(w, '\\p{L}')) AS ws FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, lang, length(text) AS chars, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^"""
    + quality.DIACRITICS
    + """]', '', 'g')) AS accented, len(regexp_extract_all(text, '[\\p{L}\\p{N}][\\x{FFFD}\\x{E000}-\\x{F8FF}]|[\\x{FFFD}\\x{E000}-\\x{F8FF}][\\p{L}\\p{N}]')) AS unreadable, len(ws) AS words, len(list_filter(ws, lambda w: length(w) = 1)) AS single, len(list_filter(ws, lambda w: length(w) > 1 AND NOT regexp_matches(w, '[0-9]') AND NOT regexp_matches(w, '["""
    + quality.VOWELS
    + """]'))) AS vowelless FROM t),
d AS (SELECT *, CASE WHEN letters < 400 THEN NULL WHEN unreadable * 500 > chars THEN 'unreadable' WHEN words = 0 THEN NULL WHEN vowelless * 100 > words * 10 THEN 'impossible_words' WHEN single * 100 > words * 50 THEN 'letters_not_words' WHEN lang IN ('es', 'pt') AND accented * 1000 < letters * 2 THEN 'missing_diacritics' END AS degradation FROM c)
"""
)


@query("prd_text_degradation", QUALITY + "SELECT doc_id, letters, words, degradation FROM d")
def prd_text_degradation(spark, d):
    return _quality_pages(spark, d).select("doc_id", "letters", "words", "degradation")


@query("prd_route", QUALITY + "SELECT doc_id, CASE WHEN r = 'direct_text_useful' THEN 'direct' ELSE 'ocr' END AS route, r AS reason_code FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'raster_content_detected' WHEN words = 0 THEN 'direct_text_insufficient' WHEN degradation IS NOT NULL THEN 'direct_text_degraded_' || degradation ELSE 'direct_text_useful' END AS r FROM d) z")
def prd_route(spark, d):
    pages = _quality_pages(spark, d).withColumn("raster", F.col("doc_id") % 7 == 0).withColumn("trusted", F.col("words") > 0)
    return quality.route(pages).select("doc_id", "route", "reason_code")


@query("srt_voting_windows")
def srt_voting_windows(spark, d):
    return quality.voting_windows(spread(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")))


@query("win_paragraph_break")
def win_paragraph_break(spark, d):
    return paragraphs.breaks(view(spark, d, "lines"))


@query("agg_paragraph_text")
def agg_paragraph_text(spark, d):
    return paragraphs.paragraph_groups(view(spark, d, "lines"))


@query("prj_page_units")
def prj_page_units(spark, d):
    """Pages to reading units, end to end."""
    return normalise.units(view(spark, d, "lines"))


@query("win_footnote_rule", "SELECT l.block_id, $LIKE(l.text, $R'^[0-9]{1,3}[.)]\\s') AND l.confidence >= 0.6 AND l.y <= p.min_y + 0.25 * (p.max_top - p.min_y) AS footnote FROM lines l JOIN page_lines p ON l.document_id = p.document_id AND l.page_index = p.page_index WHERE l.text IS NOT NULL")
def win_footnote_rule(spark, d):
    lines = view(spark, d, "lines").where("text IS NOT NULL")
    page = view(spark, d, "lines").groupBy("document_id", "page_index").agg(F.min("y").alias("lo"), F.max(F.col("y") + F.col("h")).alias("hi"))
    return lines.join(page, ["document_id", "page_index"]).select("block_id", (F.col("text").rlike("^[0-9]{1,3}[.)]\\s") & (F.col("confidence") >= 0.6) & (F.col("y") <= F.col("lo") + 0.25 * (F.col("hi") - F.col("lo")))).alias("footnote"))


@query("win_heading_continuation")
def win_heading_continuation(spark, d):
    """Headings with the lower-case lines that go on with them, up to thirty words: a fold over the page."""
    lines = view(spark, d, "lines").where("text IS NOT NULL").withColumn("words", F.size(F.split("text", "\\s+")))
    page = lines.groupBy("document_id", "page_index").agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("o"), "x", "block_id", "text", "words"))).alias("ls"))
    fold = F.aggregate(
        F.slice("ls", 2, 1 << 20),
        F.struct(F.col("ls")[0]["block_id"].alias("head"), F.col("ls")[0]["words"].alias("words"), F.lit(False).alias("closed")),
        lambda a, x: F.when(~a["closed"] & x["text"].rlike("^[\\p{Ll}]") & (a["words"] + x["words"] <= 30), F.struct(a["head"].alias("head"), (a["words"] + x["words"]).alias("words"), F.lit(False).alias("closed"))).otherwise(F.struct(a["head"].alias("head"), a["words"].alias("words"), F.lit(True).alias("closed"))),
    )
    return page.select("document_id", "page_index", fold.alias("f")).select("document_id", "page_index", F.col("f.head").alias("head"), F.col("f.words").alias("words"))


@query("agg_cer")
def agg_cer(spark, d):
    block = F.concat("document_id", F.lit("-p"), F.col("page_index").cast("string"), F.lit("-direct-"), F.col("block_order").cast("string"))
    printed = view(spark, d, "paragraphs").select("document_id", "page_index", "block_id", block.alias("line_id"), "text")
    read = view(spark, d, "lines").where("text IS NOT NULL").select("document_id", "page_index", F.col("block_id").alias("line_id"), F.col("text").alias("reading"))
    pairs = printed.join(read, ["document_id", "page_index", "line_id"])
    return map_rows(pairs, ["block_id", "text", "reading"], "block_id string, edits int, ref_length int, cer double, passed boolean", lambda ids, ts, rs: ((i, *prosody.character_error(r, t)) for i, t, r in zip(ids, ts, rs)))


@query("agg_text_quality", QUALITY.replace("SELECT doc_id, text, lower(trim(lang)) AS lang,", "SELECT block_id AS doc_id, text, NULL AS lang,").replace("FROM documents WHERE text IS NOT NULL", "FROM (SELECT block_id, min(text) AS text FROM blocks WHERE degradation IS NULL AND text IS NOT NULL GROUP BY block_id)") + "SELECT doc_id AS block_id, chars, letters, accented, unreadable, words, single, vowelless FROM d")
def agg_text_quality(spark, d):
    return quality.counters(spread(view(spark, d, "paragraphs").select("block_id", "text"))).drop("text")


def _folded(text: str) -> str:
    """Case and diacritics folded, white space single."""
    plain = "".join(c for c in unicodedata.normalize("NFD", " ".join(text.split()).lower()) if unicodedata.category(c)[0] != "M")
    return unicodedata.normalize("NFC", plain)


@query("fn_fold")
def fn_fold(spark, d):
    return map_rows(view(spark, d, "truth").where("text IS NOT NULL"), ["block_id", "text"], "block_id string, folded string", lambda ids, ts: ((i, _folded(t)) for i, t in zip(ids, ts)))


@query("fn_spoken_normalize")
def fn_spoken_normalize(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"))
    return map_rows(docs, ["doc_id", "text", "lang"], "doc_id long, normalized string", lambda ids, ts, ls: ((i, prosody.normalize(t, lang)) for i, t, lang in zip(ids, ts, ls)))


@query("fn_visual_match")
def fn_visual_match(spark, d):
    """Rasters of four channels, made of vectors, each against the next: pixels with a channel that differs by more than 5."""
    r = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor((v + 1) * 127.5).cast("int")).alias("px"))
    pairs = r.join(r.select((F.col("vec_id") - 1).alias("vec_id"), F.col("px").alias("other")), "vec_id")
    far = F.zip_with("px", "other", lambda a, b: F.abs(a - b) > 5)
    pixels = F.transform(F.sequence(F.lit(0), F.floor(F.size("px") / 4) - 1), lambda i: F.exists(F.slice(far, (i * 4 + 1).cast("int"), 3), lambda x: x))
    p = pairs.select("vec_id", F.size(F.filter(pixels, lambda x: x)).alias("differing"), F.floor(F.size("px") / 4).alias("n"))
    return p.select("vec_id", "differing", (F.col("differing") * 200 <= F.col("n")).alias("matches"))


@query("fn_nfc", "SELECT block_id, nfc_normalize(text) AS nfc FROM truth WHERE text IS NOT NULL")
def fn_nfc(spark, d):
    return map_rows(view(spark, d, "truth").where("text IS NOT NULL"), ["block_id", "text"], "block_id string, nfc string", lambda ids, ts: ((i, unicodedata.normalize("NFC", t)) for i, t in zip(ids, ts)))


def _le(v: str) -> str:
    h = f"printf('%016x', strlen({v}))"
    return "unhex(" + " || ".join(f"substr({h}, {15 - 2 * i}, 2)" for i in range(8)) + ")"


def _id_sql(prefix: str, parts: list[str]) -> str:
    return f"'{prefix}_' || sha256(" + " || ".join(f"{_le(p)} || encode({p})" for p in parts) + ")"


@query("fn_stable_id", f"SELECT block_id, {_id_sql('unit', ['document_id', 'cast(page_index AS varchar)', 'block_id', chr(39) + 'paragraph' + chr(39), chr(39) + '0' + chr(39)])} AS unit_id FROM truth")
def fn_stable_id(spark, d):
    return view(spark, d, "truth").select("block_id", stable_id("unit", F.col("document_id"), F.col("page_index").cast("string"), F.col("block_id"), F.lit("paragraph"), F.lit("0")).alias("unit_id"))


@query("fn_page_id", f"SELECT request_id, {_id_sql('page', ['document_id', chr(39) + 'page' + chr(39), 'cast(page_index AS varchar)'])} AS page_id FROM candidates")
def fn_page_id(spark, d):
    return view(spark, d, "candidates").select("request_id", stable_id("page", F.col("document_id"), F.lit("page"), F.col("page_index").cast("string")).alias("page_id"))


def _units(spark, d):
    return view(spark, d, "units").where("text IS NOT NULL")


@query("fn_is_prosodic")
def fn_is_prosodic(spark, d):
    return map_rows(_units(spark, d), ["unit_id", "text"], "unit_id string, pauses int", lambda ids, ts: ((i, sum(prosody.is_pause(t, k) for k in range(len(t)))) for i, t in zip(ids, ts)))


@query("fn_split_sentences")
def fn_split_sentences(spark, d):
    return map_rows(_units(spark, d), ["unit_id", "text"], "unit_id string, sentence_no int, sentence string", lambda ids, ts: ((i, n, s) for i, t in zip(ids, ts) for n, s in enumerate(prosody.sentences(t))))


@query("fn_split_parts")
def fn_split_parts(spark, d):
    return map_rows(_units(spark, d), ["unit_id", "text"], "unit_id string, part_no int, kind string, value string", lambda ids, ts: ((i, n, k, v) for i, t in zip(ids, ts) for n, (k, v) in enumerate(prosody.parts(prosody.normalize(t, "es")))))


@query("fn_chunk_text")
def fn_chunk_text(spark, d):
    return map_rows(_units(spark, d), ["unit_id", "text"], "unit_id string, chunk_no int, chunk string", lambda ids, ts: ((i, n, c) for i, t in zip(ids, ts) for n, c in enumerate(prosody.chunks(t, 400))))


@query("fn_chunk_legacy")
def fn_chunk_legacy(spark, d):
    return map_rows(_units(spark, d), ["unit_id", "text"], "unit_id string, chunk_no int, chunk string", lambda ids, ts: ((i, n, c) for i, t in zip(ids, ts) for n, c in enumerate(prosody.balanced_chunks(t))))


@query("prj_segments_build")
def prj_segments_build(spark, d):
    """Chunks as segments with a running sample offset within the unit."""
    w = Window.partitionBy("unit_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    return fn_chunk_text(spark, d).select("unit_id", F.col("chunk_no").alias("segment_index"), (F.char_length("chunk") * 1200).alias("sample_count"), F.coalesce(F.sum(F.char_length("chunk") * 1200).over(w), F.lit(0)).alias("unit_sample_offset"))


def _scanned_lines(spark, d):
    """(printed, read): the printed lines of all scanned blocks, placed where the recognised line of their number over
    the whole page stands, and the recognised lines that may be their readings."""
    blocks = view(spark, d, "truth").where("degradation = 'scanned' AND text IS NOT NULL").withColumn("ls", F.split("text", "\n"))
    pages = blocks.groupBy("document_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("block_order", "block_id", "ls"))).alias("bs"))
    ls = F.flatten(F.transform("bs", lambda b: F.transform(b["ls"], lambda t, i: F.struct(b["block_id"].alias("of"), i.alias("line_no"), t.alias("text")))))
    printed = pages.select("document_id", "page_index", F.posexplode(ls).alias("n", "l")).select("document_id", "page_index", "n", "l.*", F.concat_ws("-", "l.of", F.lit("line"), "l.line_no").alias("block_id"))
    ocr = cut(view(spark, d, "lines").where("block_id LIKE '%-ocr-%'").withColumn("n", F.regexp_extract("block_id", "([0-9]+)$", 1).cast("int")))
    places = ocr.groupBy("document_id", "page_index", "n").agg(F.min("y").alias("y"), F.max("h").alias("h"))
    return cut(printed.join(places, ["document_id", "page_index", "n"], "left")), ocr.where("text IS NOT NULL AND confidence >= 0.75")


def _line_pairs(spark, d):
    """Every printed line with the recognised line that it is; without one, ``ocr_id`` and ``reading`` are null."""
    printed, read = _scanned_lines(spark, d)
    best = matching.fuzzy_lines(printed, read).select(F.col("a_id").alias("line_id"), F.col("b_id").alias("ocr_id"))
    readings = read.groupBy(F.col("block_id").alias("ocr_id")).agg(F.min("text").alias("reading"))
    lines = printed.select(F.col("of").alias("block_id"), "line_no", F.col("block_id").alias("line_id"), "text")
    return lines.join(best.join(readings, "ocr_id"), "line_id", "left").select("block_id", "line_no", "ocr_id", "text", "reading")


@query("fn_lcs_pairs")
def fn_lcs_pairs(spark, d):
    return map_rows(_line_pairs(spark, d), ["block_id", "line_no", "ocr_id", "text", "reading"], "block_id string, line_no int, ocr_id string, common int", lambda b, n, o, ts, rs: ((x, y, z, len(prosody.lcs_pairs(t, r or ""))) for x, y, z, t, r in zip(b, n, o, ts, rs)))


@query("fn_repair_runs")
def fn_repair_runs(spark, d):
    """Every printed line; one without a reading stays as it is."""
    return map_rows(_line_pairs(spark, d), ["block_id", "line_no", "ocr_id", "text", "reading"], "block_id string, line_no int, ocr_id string, repaired string", lambda b, n, o, ts, rs: ((x, y, z, t if r is None else prosody.repair_runs(t, r)) for x, y, z, t, r in zip(b, n, o, ts, rs)))


@query("fn_repair_page")
def fn_repair_page(spark, d):
    return fn_repair_runs(spark, d).groupBy("block_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_set(F.struct("line_no", "repaired"))), lambda x: x["repaired"])).alias("text"))


@query("agg_block_order_lcs")
def agg_block_order_lcs(spark, d):
    t = table(spark, d, "blocks").where("degradation IS NULL AND text IS NOT NULL").dropDuplicates(["block_id"]).groupBy("document_id", "page_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_order", "text"))), lambda x: x["text"]).alias("expected"))
    p = view(spark, d, "lines").where("text IS NOT NULL AND block_id LIKE '%-direct-%'").groupBy("document_id", "page_index").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.regexp_extract("block_id", "([0-9]+)$", 1).cast("int").alias("k"), "text"))), lambda x: x["text"]).alias("got"))
    return map_rows(t.join(p, ["document_id", "page_index"]), ["document_id", "page_index", "expected", "got"], "document_id string, page_index int, ratio double, passed boolean", lambda ds, ps, es, gs: ((a, b, r := round(prosody.lcs_length(e, g) / max(len(e), len(g), 1), 9), r >= 0.98) for a, b, e, g in zip(ds, ps, es, gs)))


@query("join_ocr_line_fuzzy")
def join_ocr_line_fuzzy(spark, d):
    """Printed lines of scanned blocks, placed by their number over the page, with the recognised line they are."""
    return matching.fuzzy_lines(*_scanned_lines(spark, d))


@query("agg_order_votes")
def agg_order_votes(spark, d):
    return matching.vote_ranks(view(spark, d, "rects"))


@query("prj_spread_regions")
def prj_spread_regions(spark, d):
    return matching.spread_regions(view(spark, d, "rects"), 200)


def _detected(spark, d) -> DataFrame:
    """Boxes a detector might give for the regions of the ground truth: each moved and grown by what its id hashes to."""
    r = view(spark, d, "regions")
    h = F.xxhash64("id")
    move = lambda k, n: F.pmod(F.shiftright(h, k), F.lit(n)) - n // 2
    return r.select((F.concat(F.lit("d-"), "id")).alias("id"), "page", (F.col("x") + move(3, 41)).alias("x"), (F.col("y") + move(11, 41)).alias("y"), (F.col("w") * (1 + move(19, 21) / 50)).alias("w"), (F.col("h") * (1 + move(27, 21) / 50)).alias("h"), "role", (F.col("confidence") * (1 - F.pmod(F.shiftright(h, 35), F.lit(10)) / 50)).alias("confidence"))


@query("join_iou_greedy")
def join_iou_greedy(spark, d):
    return matching.greedy_pairs(view(spark, d, "regions"), _detected(spark, d), 0.5)


@query("agg_iou_stats")
def agg_iou_stats(spark, d):
    return matching.match_report(view(spark, d, "regions").select("page", "id", "x", "y", "w", "h", "role", "confidence"), _detected(spark, d))


@query("join_spatial_cluster")
def join_spatial_cluster(spark, d):
    return matching.first_fit_clusters(view(spark, d, "rects").select("page", "id", "x", "y", "w", "h"))


def _actions(spark, d):
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "complete", "click", "fail", "error", "retry", "purchase", "skip", "signup", "show")]), F.col("event_type"))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), kind.alias("action"), (F.col("event_id") % 8).cast("int").alias("page_index"), "ts")


@query("st_session_fsm")
def st_session_fsm(spark, d):
    return sessions.fold_sessions(_actions(spark, d))


@query("st_narration_queue")
def st_narration_queue(spark, d):
    ops = F.when(F.col("action") == "complete", "append").when(F.col("action") == "show", "finish").otherwise("advance")
    return sessions.fold_queues(_actions(spark, d).withColumn("action", ops))


def _drain(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and return its result table, written in the shared folder."""
    spark = df.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(f"{base}/out")

    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _stream(spark, d, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them: a stream reads folders, and the name of the
    table picks the one file out of the folder of all tables."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    source = spark.readStream.schema(table(spark, d, name).schema)
    df = source.parquet(f"{d}/{name}.parquet") if folder else source.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


@query("st_window_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type")
def st_window_counts(spark, d):
    return _drain(streams.tumbling_counts(_stream(spark, d, "events")), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("st_dedupe_watermark", "SELECT DISTINCT event_id, user_id FROM events")
def st_dedupe_watermark(spark, d):
    return _drain(streams.once(_stream(spark, d, "events")).select("event_id", "user_id"), "append")


@query("st_session_window")
def st_session_window(spark, d):
    ev = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


@query("st_furniture_incremental")
def st_furniture_incremental(spark, d):
    """Pages as they arrive: each is observed, then stripped with the evidence so far."""
    pages = _stream(spark, d, "page_candidates").select("document_id", "page_index", F.concat(F.coalesce("direct_blocks", F.array()), F.coalesce("ocr_blocks", F.array())).alias("lines"))
    return _drain(streams.furniture_incremental(pages), "append")


@query("st_bounded_buffer")
def st_bounded_buffer(spark, d):
    ops = _stream(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("view", "click"), "push").otherwise("pop").alias("operation"))
    return _drain(streams.bounded_buffer(ops, 4), "update")


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@query("src_worker_ndjson", "SELECT document_id, page_index, block_id FROM lines")
def src_worker_ndjson(spark, d):
    """Write the lines as newline-delimited worker responses and read them through the source again."""
    path = f"{_folder(spark)}/worker"
    lines = view(spark, d, "lines")
    files.write_rows(lines.groupBy("document_id", "page_index").agg(F.collect_list(F.struct("block_id", "text", "x", "y", "w", "h", "confidence")).alias("blocks")), path)
    return files.read_worker(spark, path).where("_corrupt IS NULL").select("document_id", "page_index", F.explode("blocks").alias("b")).select("document_id", "page_index", "b.block_id")


@query("src_corpus_manifest", "SELECT document_id AS id, entry_role AS role, page_count FROM entries")
def src_corpus_manifest(spark, d):
    """Manifests of at most 500 entries a file, far below the size limit that the source checks, read back through it."""
    path = f"{_folder(spark)}/manifest"
    e = view(spark, d, "entries").select(F.struct(F.col("document_id").alias("id"), F.col("entry_role").alias("role"), "page_count").alias("e"))
    parts = max(4, -(-e.count() // 500))
    files.write_documents(e.groupBy(F.pmod(F.xxhash64("e.id"), F.lit(parts)).alias("k")).agg(F.collect_list("e").alias("entries")).drop("k"), path, parts)
    return files.read_manifest(spark, path).select("id", "role", "page_count")


@query("snk_state_store", "SELECT document_id, page_index, n_direct FROM candidates")
def snk_state_store(spark, d):
    path = f"{_folder(spark)}/state"
    files.write_state(view(spark, d, "candidates").select(F.lit(1).alias("version"), F.pmod(F.hash("document_id"), F.lit(8)).alias("bucket"), "document_id", "page_index", "n_direct").withColumn("document", F.col("document_id")).withColumn("document_id", F.col("bucket").cast("string")).drop("bucket"), path)
    return spark.read.parquet(path).select(F.col("document").alias("document_id"), "page_index", "n_direct")


@query("src_dir_walk")
def src_dir_walk(spark, d):
    return files.list_files(spark, d).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", "sha256_hex")


SENTENCES = "WITH s AS (SELECT document_id, page_index, block_id, string_split(regexp_replace(trim(text), '([.!?…])\\s+', '\\1' || chr(30), 'g'), chr(30)) AS ss FROM paragraphs) SELECT document_id, page_index, block_id, unnest(generate_series(0, len(ss) - 1)) AS sentence_no, unnest(ss) AS text FROM s"


@query("src_ground_truth", SENTENCES)
def src_ground_truth(spark, d):
    """Ground truth written a page a line with its paragraphs and sentences, and read back through the source."""
    path = f"{_folder(spark)}/truth"
    ss = F.split(F.regexp_replace(F.trim("text"), "([.!?…])\\s+", "$1\x1e"), "\x1e")
    sentences = F.transform(ss, lambda s, i: F.struct(F.concat(F.lit("s"), i.cast("string")).alias("sentence_id"), s.alias("text")))
    block = F.struct("block_id", F.col("block_order").alias("order"), "text", F.array(F.struct(F.lit("p0").alias("paragraph_id"), sentences.alias("sentences"))).alias("paragraphs"))
    pages = view(spark, d, "paragraphs").groupBy("document_id", "page_index").agg(F.collect_list(block).alias("blocks"))
    files.write_rows(pages.select("document_id", F.lit(1).alias("revision"), F.array(F.struct("page_index", "blocks")).alias("pages")), path)
    return files.read_truth(spark, path, lines=True).select("document_id", "page_index", "block_id", F.col("sentence_no").cast("long").alias("sentence_no"), "text")


@query("src_model_manifest", "SELECT document_id AS id, sha256_hex, byte_size AS size_bytes, coalesce(regexp_matches(sha256_hex, '^[0-9a-f]{64}$'), false) AND coalesce(byte_size, 0) > 0 AND file_path IS NOT NULL AS valid FROM entries")
def src_model_manifest(spark, d):
    path = f"{_folder(spark)}/models"
    e = view(spark, d, "entries")
    files.write_rows(e.select(F.col("document_id").alias("id"), F.array(F.struct("sha256_hex", F.col("byte_size").alias("size_bytes"), F.col("file_path").alias("relative_path"))).alias("artifacts")), path)
    return files.read_models(spark, path, lines=True).select("id", "sha256_hex", "size_bytes", "valid")


@query("src_state_load", "SELECT document_id, page_index FROM candidates")
def src_state_load(spark, d):
    path = f"{_folder(spark)}/state"
    files.write_rows(view(spark, d, "candidates").select("document_id", "page_index"), path)
    return files.read_state(spark, path, "document_id string, page_index int").select("document_id", "page_index")


@query("snk_metrics_jsonl", "SELECT unit_id, segment_index, sample_count FROM segments")
def snk_metrics_jsonl(spark, d):
    path = f"{_folder(spark)}/metrics"
    files.write_rows(view(spark, d, "segments").select("unit_id", "segment_index", "sample_count"), path)
    return spark.read.schema("unit_id long, segment_index int, sample_count long").json(path)


@query("snk_report_json", "SELECT language, count(*) AS n FROM entries GROUP BY language")
def snk_report_json(spark, d):
    path = f"{_folder(spark)}/report"
    files.write_rows(view(spark, d, "entries").groupBy("language").agg(F.count("*").alias("n")), path)
    return spark.read.schema("language string, n long").json(path)


@query("fn_equiv_glyph")
def fn_equiv_glyph(spark, d):
    """Characters two readings of a line share once quotation marks and dashes of a kind are equal."""
    return fn_lcs_pairs(spark, d).groupBy("block_id").agg(F.sum("common").alias("common"))
