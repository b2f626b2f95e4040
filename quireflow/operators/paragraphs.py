"""Lines to paragraphs: break rules between neighbours and a two-state automaton over the page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.native import nearest_percentile, stable_id, upper_median

PAGE = ("document_id", "page_index")


def column_keys(lines: DataFrame) -> list[str]:
    return [*PAGE, "col"] if "col" in lines.columns else list(PAGE)


def page_metrics(lines: DataFrame) -> DataFrame:
    """Upper median height, 10th percentile of left and 90th of right edges of the reliable lines of a page, or of each
    of its columns where the lines have ``col``."""
    good = lines.where("w > 0 AND h > 0 AND coalesce(confidence, 0) >= 0.6")
    by = column_keys(lines)
    return good.groupBy(*by).agg(F.collect_list("h").alias("hs"), F.collect_list("x").alias("xs"), F.collect_list(F.col("x") + F.col("w")).alias("rs")).select(
        *by, upper_median(F.col("hs")).alias("mh"), nearest_percentile(F.col("hs"), 0.75).alias("p75"), nearest_percentile(F.col("xs"), 0.1).alias("left"), nearest_percentile(F.col("rs"), 0.9).alias("right")
    )


def breaks(lines: DataFrame) -> DataFrame:
    """Adds pos and starts: whether the line begins a paragraph.

    The line before is the neighbour, or the one before it where the neighbour is only punctuation on the same
    visual line and did not itself begin a group: so each flag depends on the last. Both candidates are computed as
    columns and resolved by one fold over the page's lines. Lines that have a column ``col`` are read column by
    column, and the first of a column begins a paragraph.
    """
    column = F.col("col") if "col" in lines.columns else F.lit(0)
    order = Window.partitionBy(*PAGE).orderBy(column, F.desc("y"), "x", "block_id")
    d = lines.where("text IS NOT NULL").join(page_metrics(lines), column_keys(lines), "left").withColumn("pos", F.row_number().over(order)).withColumn("cy", F.col("y") + F.col("h") / 2)
    d = d.withColumn("conf", F.coalesce("confidence", F.lit(0.0)))

    def starts(k: int):
        p = {c: F.lag(c, k).over(order) for c in ("cy", "h", "x", "w", "conf")}
        same = (F.abs(F.col("cy") - p["cy"]) < 0.5 * F.col("mh")) & (F.col("x") - (p["x"] + p["w"])).between(-0.5 * F.col("mh"), F.col("mh"))
        span = F.col("right") - F.col("left")
        rule = (
            F.when(p["cy"].isNull() | (F.lag(column, k).over(order) != column) | F.col("mh").isNull() | (F.col("conf") < 0.6) | (p["conf"] < 0.6), True)
            .when(same, False)
            .when(F.abs(F.col("conf") - p["conf"]) > 0.25, True)
            .when(p["cy"] - F.col("cy") > 2.1 * F.col("mh"), True)
            .when(p["x"] + p["w"] < F.col("right") - 0.1 * span, True)
            .when(F.col("x") > p["x"] + F.greatest(0.02 * span, 0.4 * F.col("mh")), True)
            .otherwise(False)
        )
        return F.coalesce(rule, F.lit(True)), F.coalesce(same, F.lit(False))

    fa, same = starts(1)
    fb, _ = starts(2)
    d = d.withColumn("fa", fa).withColumn("fb", fb).withColumn("_same", same)
    punct = F.coalesce(F.lag(~F.col("text").rlike("[\\p{L}\\p{N}]") & F.col("_same")).over(order), F.lit(False))
    d = d.withColumn("via", punct)
    page = d.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("pos", "fa", "fb", "via", "block_id"))).alias("ls"))
    fold = F.aggregate(
        "ls",
        F.array().cast("array<struct<block_id:string,pos:int,starts:boolean>>"),
        lambda acc, x: F.concat(
            acc,
            F.array(F.struct(x["block_id"].alias("block_id"), x["pos"].alias("pos"), F.when(x["via"] & ~F.coalesce(F.get(acc, F.size(acc) - 1)["starts"], F.lit(True)), x["fb"]).otherwise(x["fa"]).alias("starts"))),
        ),
    )
    flags = page.select(*PAGE, F.explode(fold).alias("f")).select(*PAGE, "f.*")
    return flags


def joined_text(ls):
    """The text of lines in order, divided words joined."""
    return F.aggregate(ls, F.lit(""), lambda acc, x: F.when(acc == "", x["text"]).when(acc.rlike("-$"), F.concat(F.regexp_replace(acc, "-$", ""), x["text"])).otherwise(F.concat(acc, F.lit(" "), x["text"])))


def paragraph_groups(lines: DataFrame) -> DataFrame:
    """document_id, page_index, group_no, unit_id, blocks, text: paragraphs with line-end hyphens healed."""
    flags = breaks(lines)
    w = Window.partitionBy(*PAGE).orderBy("pos")
    g = flags.withColumn("group_no", F.sum(F.col("starts").cast("int")).over(w) - 1)
    g = g.join(lines.select(*PAGE, "block_id", "text"), [*PAGE, "block_id"])
    grouped = g.groupBy(*PAGE, "group_no").agg(F.array_sort(F.collect_list(F.struct("pos", "block_id", "text"))).alias("ls"))
    text = joined_text(F.col("ls"))
    first = F.col("ls")[0]["block_id"]
    uid = stable_id("unit", F.col("document_id"), F.col("page_index").cast("string"), first, F.lit("paragraph"), F.lit("0"))
    return grouped.select(*PAGE, "group_no", uid.alias("unit_id"), F.size("ls").alias("blocks"), text.alias("text"))
