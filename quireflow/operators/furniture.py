"""Repeated page furniture: running heads, feet and folios found by repetition and removed.

Two passes over the lines of all pages: aggregate what stands at page edges by document and template, then
semi-join the edges with the templates that qualify. Both shuffle by document and template, never whole documents
into one task, so a document of any number of pages is spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.native import template, upper_median
from ..runtime import cut

PAGE = ("document_id", "page_index")
MAX_SLOTS = 6


def edge_lines(lines: DataFrame) -> DataFrame:
    """Lines in the top or bottom slots of their page, with template, literal and whether they are narrow.

    At most six slots and half the page at each edge; a slot beyond the second gap of more than three median line
    heights is not reached. Lines without height or text are ignored. All of it is windows over the page, so the
    lines are shuffled once.
    """
    page = Window.partitionBy(*PAGE)
    down, up = page.orderBy(F.desc("cy"), "block_id"), page.orderBy("cy", "block_id")
    d = lines.where("h IS NOT NULL AND text IS NOT NULL").withColumn("cy", F.col("y") + F.col("h") / 2)
    d = d.withColumn("n", F.count("*").over(page)).withColumn("mh", upper_median(F.collect_list("h").over(page))).withColumn("span", F.max(F.col("x") + F.col("w")).over(page) - F.min("x").over(page))
    d = d.withColumn("i", F.row_number().over(down)).withColumn("j", F.row_number().over(up))
    d = d.withColumn("gap_above", (F.lag("cy").over(down) - F.col("cy") > 3 * F.col("mh")).cast("int")).withColumn("gap_below", (F.col("cy") - F.lag("cy").over(up) > 3 * F.col("mh")).cast("int"))
    d = d.withColumn("above", F.sum(F.coalesce("gap_above", F.lit(0))).over(down)).withColumn("below", F.sum(F.coalesce("gap_below", F.lit(0))).over(up))
    slots = F.least(F.lit(MAX_SLOTS), F.floor(F.col("n") / 2))
    top = (F.col("i") <= slots) & (F.col("above") <= 1)
    bottom = (F.col("j") <= slots) & (F.col("below") <= 1)
    return d.where(top | bottom).select(*PAGE, "block_id", top.alias("top"), template(F.col("text")).alias("template"), F.trim(F.regexp_replace("text", "\\s+", " ")).alias("literal"), (F.col("w") * 100 <= 75 * F.col("span")).alias("narrow")).where("template <> ''")


def _repeats(seen: str) -> F.Column:
    """On 60 % of the document's pages with edges, or on three and 60 % of those of one parity."""
    whole = F.col(seen) * 5 >= F.col("eligible") * 3
    parity = [(F.col(f"{seen}_{p}") >= 3) & (F.col(f"{seen}_{p}") * 5 >= F.col(f"eligible_{p}") * 3) for p in ("even", "odd")]
    return whole | parity[0] | parity[1]


def _pages(alias: str) -> list:
    """Counts of pages, of even and of odd ones, over rows that are one for each page."""
    even = F.col("page_index") % 2 == 0
    return [F.count("*").alias(alias), F.count_if(even).alias(f"{alias}_even"), F.count_if(~even).alias(f"{alias}_odd")]


def tally(edges: DataFrame, *keys: str) -> DataFrame:
    """keys, pages, headers, footers, narrow, wide of the edge lines; rows are made distinct by page before they are counted."""
    by_page = edges.groupBy(*keys, "page_index").agg(F.count_if("top").alias("headers"), F.count_if(~F.col("top")).alias("footers"), F.count_if("narrow").alias("narrow"), F.count_if(~F.col("narrow")).alias("wide"))
    return by_page.groupBy(*keys).agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("headers", "footers", "narrow", "wide")])


def verdicts(edges: DataFrame) -> DataFrame:
    """document_id, template, literal, by_template, exact, rule: every text seen at an edge, and whether it goes because
    of its template or because it repeats letter for letter.

    Each count is of rows already distinct by page, so no aggregate has to expand its input for distinct counts."""
    cells = edges.groupBy("document_id", "template", "literal", "page_index").agg(F.count_if("top").alias("heads"), F.count_if(~F.col("top")).alias("feet"), F.count_if("narrow").alias("thin"), F.count_if(~F.col("narrow")).alias("wide"))
    by_page = cells.groupBy("document_id", "template", "page_index").agg(*[F.sum(c).alias(c) for c in ("heads", "feet", "thin", "wide")])
    tally = by_page.groupBy("document_id", "template").agg(*_pages("seen"), *[F.sum(c).alias(c) for c in ("heads", "feet", "thin", "wide")])
    eligible = edges.select(*PAGE).distinct().groupBy("document_id").agg(*_pages("eligible"))
    literal = cells.groupBy("document_id", "template", "literal").agg(*_pages("same"))
    d = literal.join(tally.join(eligible, "document_id"), ["document_id", "template"])
    masked = F.col("template").contains("#") & (F.col("seen") >= 3) & _repeats("seen") & (F.char_length("template") <= 120) & (F.col("thin") >= F.col("wide"))
    plain = ~F.col("template").contains("#") & (((F.col("seen") >= 2) & (F.col("seen") == F.col("eligible"))) | ((F.col("seen") >= 3) & _repeats("seen")))
    exact = (F.col("same") >= 3) & _repeats("same")
    rule = F.when(F.col("feet") >= F.col("heads"), "remove_repeated_footer").otherwise("remove_repeated_header")
    return d.select("document_id", "template", "literal", (masked | plain).alias("by_template"), exact.alias("exact"), rule.alias("rule")).where("by_template OR exact")


def qualified(edges: DataFrame) -> DataFrame:
    """document_id, template, literal (null: every literal of the template), rule."""
    v = verdicts(edges)
    return v.select("document_id", "template", F.when(~F.col("by_template"), F.col("literal")).alias("literal"), "rule").distinct()


def removed(lines: DataFrame) -> DataFrame:
    """document_id, page_index, block_id, rule of every line removed as furniture. The edge lines, few of all, are
    written once for the counts and for the lines themselves."""
    edges = cut(edge_lines(lines))
    return edges.join(verdicts(edges).select("document_id", "template", "literal", "rule"), ["document_id", "template", "literal"]).select(*PAGE, "block_id", "rule").distinct()


def kept(lines: DataFrame) -> DataFrame:
    return lines.join(removed(lines).select(*PAGE, "block_id"), [*PAGE, "block_id"], "left_anti")
