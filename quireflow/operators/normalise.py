"""Page normalisation end to end: lines to ordered reading units with class, disposition, region and decision trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.native import stable_id
from . import furniture, paragraphs

PAGE = ("document_id", "page_index")
GUTTER = 12.0
TOC = "\\s*\\.{3,}\\s*[0-9]+\\s*$"
NUMERAL = "^\\s*([0-9]{1,3})(?:[.)\\]](?:\\s|$)|\\s\\p{Lu})"


def with_columns(lines: DataFrame) -> DataFrame:
    """Adds ``boundary`` and ``col``: a page of at least four lines is parted at the widest gap of 12 points or more
    with two lines on either side; of equally wide gaps at the last."""
    page = Window.partitionBy(*PAGE)
    across = page.orderBy("x", "block_id")
    d = lines.withColumn("_edge", F.max(F.col("x") + F.col("w")).over(across.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead("x").over(across))
    d = d.withColumn("_i", F.row_number().over(across)).withColumn("_n", F.count("*").over(page))
    gap = F.when((F.col("_n") >= 4) & (F.col("_i") >= 2) & (F.col("_n") - F.col("_i") >= 2) & (F.col("_next") - F.col("_edge") >= GUTTER), F.struct((F.col("_next") - F.col("_edge")).alias("gap"), F.col("_i").alias("i"), F.col("_next").alias("at")))
    d = d.withColumn("boundary", F.max(gap).over(page)["at"])
    return d.withColumn("col", F.coalesce((F.col("x") >= F.col("boundary")).cast("int"), F.lit(0))).drop("_edge", "_next", "_i", "_n")


def _called(texts: Column, numeral: Column) -> Column:
    """Whether a numeral is attached to a letter or closing mark in one of the texts."""
    return F.exists(texts, lambda t: F.rlike(t, F.concat(F.lit("([\\p{L})\\]]|[^0-9]\\.)"), numeral, F.lit("([^\\p{L}\\p{N}]|$)"))))


def units(lines: DataFrame) -> DataFrame:
    """document_id, page_index, unit_no, unit_id, content_class, disposition, text, spoken_text, x, y, w, h,
    confidence, blocks, rule, trace: the reading units of every page in reading order.

    Repeated heads, feet and folios come out as units of disposition ``never`` with the rule that removed them and
    no number. The other lines are ordered column by column, joined to paragraphs, and classed: headings by size or
    isolation; notes by a numeral in the bottom quarter below body text, or by smaller type above it when the body
    calls the numeral and a note follows in the band; all after a note in its column are notes; contents entries
    lose their leader and page number when spoken; groups of low confidence are unsupported. Lines without text or
    box give no unit. Everything after the furniture is a window over one page.
    """
    lines = lines.where("text IS NOT NULL AND trim(text) <> '' AND x IS NOT NULL AND y IS NOT NULL AND w > 0 AND h > 0").select(*PAGE, "block_id", "text", "x", "y", "w", "h", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    gone = furniture.removed(lines).groupBy(*PAGE, "block_id").agg(F.min("rule").alias("rule"))
    marked = lines.join(gone, [*PAGE, "block_id"], "left")
    body = with_columns(marked.where("rule IS NULL").drop("rule"))
    flags = paragraphs.breaks(body)
    order = Window.partitionBy(*PAGE).orderBy("pos")
    d = body.join(flags.select(*PAGE, "block_id", "pos", "starts"), [*PAGE, "block_id"]).withColumn("unit_no", F.sum(F.col("starts").cast("int")).over(order) - 1)
    groups = d.groupBy(*PAGE, "unit_no").agg(
        F.min("col").alias("col"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("top"),
        F.max("h").alias("size"), F.min("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct("pos", "block_id", "text"))).alias("ls"),
    )
    g = groups.withColumn("text", paragraphs.joined_text(F.col("ls"))).withColumn("blocks", F.transform("ls", lambda l: l["block_id"])).join(paragraphs.page_metrics(body).select(*PAGE, "col", "mh", "p75"), [*PAGE, "col"], "left")
    page, seq = Window.partitionBy(*PAGE), Window.partitionBy(*PAGE).orderBy("unit_no")
    good = F.col("confidence") >= 0.6
    g = g.withColumn("band", F.min(F.when(good, F.col("y"))).over(page) + (F.max(F.when(good, F.col("top"))).over(page) - F.min(F.when(good, F.col("y"))).over(page)) * 0.25)
    g = g.withColumn("numeral", F.regexp_extract("text", NUMERAL, 1)).withColumn("numbered", good & (F.col("numeral") != "") & ~F.col("text").rlike(TOC) & (F.col("size") <= 1.25 * F.col("mh")))
    g = g.withColumn("above", F.max(F.when(good, F.col("y"))).over(page) > F.col("band"))
    low = F.col("top") <= F.col("band")
    g = g.withColumn("low", F.col("numbered") & low).withColumn("later", F.max("low").over(seq.rowsBetween(1, Window.unboundedFollowing)))
    before = F.collect_list("text").over(seq.rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("called", F.when(F.col("numbered") & ~low, _called(before, F.col("numeral"))).otherwise(False))
    note = F.col("numbered") & F.col("above") & (low | F.col("called") & (F.col("size") <= 0.9 * F.col("p75")) & F.coalesce("later", F.lit(False)))
    g = g.withColumn("note", note).withColumn("in_zone", F.max("note").over(Window.partitionBy(*PAGE, "col").orderBy("unit_no")))
    words = F.size(F.split(F.trim("text"), "\\s+"))
    far_up = F.coalesce(F.lag("y").over(seq) - F.col("top") > 2.4 * F.col("mh"), F.lit(True))
    far_down = F.coalesce(F.col("y") - F.lead("top").over(seq) > 2.4 * F.col("mh"), F.lit(True))
    heading = (F.size("blocks") <= 2) & words.between(1, 12) & ~F.trim("text").rlike("[.,;:]$") & F.trim("text").rlike("^[^\\p{L}]*\\p{Lu}") & ((F.col("size") >= 1.35 * F.col("mh")) | (F.col("size") >= 1.2 * F.col("mh")) & far_up & far_down)
    toc = F.col("text").rlike("\\p{L}.*" + TOC)
    rule = F.when(~good, "low_confidence").when(F.col("note"), "footnote").when(F.col("in_zone"), "footnote_zone").when(toc, "contents_entry").when(F.coalesce(heading, F.lit(False)), "heading").otherwise("paragraph")
    kind = F.when(F.col("rule") == "low_confidence", "unsupported").when(F.col("rule").isin("footnote", "footnote_zone"), "note").when(F.col("rule") == "heading", "heading").otherwise("prose")
    g = g.withColumn("rule", rule).withColumn("content_class", kind)
    kept = g.select(
        *PAGE, F.col("unit_no").cast("int").alias("unit_no"), "content_class", F.when(F.col("content_class").isin("prose", "heading"), "automatic").otherwise("on_demand").alias("disposition"), "text",
        F.when(F.col("rule") == "contents_entry", F.regexp_replace("text", TOC, "")).otherwise(F.col("text")).alias("spoken_text"), "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("top") - F.col("y")).alias("h"), "confidence", "blocks", "rule",
    )
    dropped = marked.where("rule IS NOT NULL").select(*PAGE, F.lit(None).cast("int").alias("unit_no"), F.lit("unsupported").alias("content_class"), F.lit("never").alias("disposition"), "text", F.lit("").alias("spoken_text"), "x", "y", "w", "h", "confidence", F.array("block_id").alias("blocks"), "rule")
    out = kept.unionByName(dropped)
    uid = stable_id("unit", F.col("document_id"), F.col("page_index").cast("string"), F.col("blocks")[0], F.col("content_class"), F.lit("0"))
    return out.withColumn("unit_id", uid).withColumn("trace", F.array(F.struct("rule", "confidence", F.col("blocks").alias("affected_segments"))))
