"""Matching of rectangles and of lines: candidates by an equi-join on the page, greedy choice per page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prosody import lcs_length
from ..runtime import ship
from .arrow import map_rows


def iou(a: str = "a", b: str = "b"):
    w = F.greatest(F.lit(0), F.least(F.col(f"{a}.x") + F.col(f"{a}.w"), F.col(f"{b}.x") + F.col(f"{b}.w")) - F.greatest(f"{a}.x", f"{b}.x"))
    h = F.greatest(F.lit(0), F.least(F.col(f"{a}.y") + F.col(f"{a}.h"), F.col(f"{b}.y") + F.col(f"{b}.h")) - F.greatest(f"{a}.y", f"{b}.y"))
    inter = w * h
    return inter / (F.col(f"{a}.w") * F.col(f"{a}.h") + F.col(f"{b}.w") * F.col(f"{b}.h") - inter)


def greedy_pairs(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """page, a, b, iou: in the order of ``left`` ids each takes the free ``right`` of its role that overlaps most."""
    ship(left.sparkSession)
    pairs = left.alias("a").join(right.alias("b"), (F.col("a.page") == F.col("b.page")) & (F.col("a.role") == F.col("b.role"))).select(F.col("a.page").alias("page"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(iou(), 9).alias("iou")).where(F.col("iou") >= least)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for a, group in pdf.sort_values(["a", "iou", "b"], ascending=[True, False, True]).groupby("a", sort=False):
            for b, v in zip(group["b"], group["iou"]):
                if b not in taken:
                    taken.add(b)
                    out.append((pdf["page"].iloc[0], a, b, v))
                    break
        return pd.DataFrame(out, columns=["page", "a", "b", "iou"])

    kinds = dict(pairs.dtypes)
    return pairs.groupBy("page").applyInPandas(run, f"page {kinds['page']}, a {kinds['a']}, b {kinds['b']}, iou double")


def match_report(expected: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """page, regions, matched, recall, mean_iou, min_iou, max_delta of greedy matching; pages without a match count too."""
    pairs = greedy_pairs(expected, found, least)
    scores = pairs.join(expected.select(F.col("id").alias("a"), F.col("confidence").alias("ca")), "a").join(found.select(F.col("id").alias("b"), F.col("confidence").alias("cb")), "b")
    per = scores.groupBy("page").agg(F.count("*").alias("matched"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.min("iou").alias("min_iou"), F.round(F.max(F.abs(F.col("ca") - F.col("cb"))), 6).alias("max_delta"))
    return expected.groupBy("page").agg(F.count("*").alias("regions")).join(per, "page", "left").select("page", "regions", F.coalesce("matched", F.lit(0)).alias("matched"), (F.coalesce("matched", F.lit(0)) / F.col("regions")).alias("recall"), "mean_iou", "min_iou", "max_delta")


def first_fit_clusters(boxes: DataFrame, gap: int = 42) -> DataFrame:
    """page, id, cluster: each box joins the first cluster whose bounding box is within ``gap``, in id order."""
    ship(boxes.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        clusters: list[list[float]] = []
        out = []
        for r in pdf.sort_values("id").itertuples():
            box = [r.x, r.y, r.x + r.w, r.y + r.h]
            for k, c in enumerate(clusters):
                if box[0] <= c[2] + gap and c[0] <= box[2] + gap and box[1] <= c[3] + gap and c[1] <= box[3] + gap:
                    clusters[k] = [min(c[0], box[0]), min(c[1], box[1]), max(c[2], box[2]), max(c[3], box[3])]
                    out.append((r.page, r.id, k))
                    break
            else:
                clusters.append(box)
                out.append((r.page, r.id, len(clusters) - 1))
        return pd.DataFrame(out, columns=["page", "id", "cluster"])

    kinds = dict(boxes.dtypes)
    return boxes.groupBy("page").applyInPandas(run, f"page {kinds['page']}, id {kinds['id']}, cluster int")


def vote_ranks(boxes: DataFrame) -> DataFrame:
    """page, id, rk: every box of a page against every other by the sigmoid of their distance in height; fewest votes
    first. Boxes of one height have equal votes, so the pairs are those of the heights, each as often as it occurs."""
    heights = boxes.groupBy("page", "y").agg(F.count("*").alias("n"))
    pairs = heights.alias("a").join(heights.alias("b"), "page")
    vote = F.col("b.n") / (1 + F.exp((F.col("b.y") - F.col("a.y")) / 100.0))
    votes = pairs.groupBy("page", F.col("a.y").alias("y")).agg(F.round(F.sum(vote) - 0.5, 6).alias("votes"))
    return boxes.join(votes, ["page", "y"]).select("page", "id", F.row_number().over(Window.partitionBy("page").orderBy("votes", "id")).alias("rk"))


def spread_regions(boxes: DataFrame, middle: int) -> DataFrame:
    """page, id, ord: the boxes left of ``middle`` in order, then those right of it; no rows for a page with one side empty."""
    right = F.col("x") >= middle
    both = Window.partitionBy("page")
    d = boxes.select("page", "id", F.row_number().over(both.orderBy(right, "y", "x", "id")).alias("rk"), F.min(right).over(both).alias("some_right"), F.max(right).over(both).alias("all_right"))
    return d.where("some_right <> all_right").select("page", "id", (F.col("rk") - 1).alias("ord"))


def fuzzy_lines(a: DataFrame, b: DataFrame, share: float = 0.6) -> DataFrame:
    """a_id, b_id, ratio: for each line the best candidate on its page whose middle is within a line height and
    whose common subsequence reaches ``share`` of the shorter text. Equal texts need no subsequence."""
    pairs = a.alias("a").join(b.alias("b"), (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.page_index") == F.col("b.page_index")) & (F.col("a.block_id") != F.col("b.block_id")) & (F.abs(F.col("a.y") - F.col("b.y")) <= F.greatest("a.h", "b.h")))
    pairs = pairs.select(F.col("a.block_id").alias("a_id"), F.col("b.block_id").alias("b_id"), F.col("a.text").alias("ta"), F.col("b.text").alias("tb"))

    def kernel(a_ids, b_ids, tas, tbs):
        for x, y, s, t in zip(a_ids, b_ids, tas, tbs):
            if s and t:
                n = min(len(s), len(t))
                ratio = 1.0 if s == t else lcs_length(list(s), list(t)) / n
                if ratio >= share:
                    yield x, y, round(ratio, 9)

    scored = map_rows(pairs, ["a_id", "b_id", "ta", "tb"], "a_id string, b_id string, ratio double", kernel)
    return scored.groupBy("a_id").agg(F.max_by("b_id", F.struct("ratio", "b_id")).alias("b_id"), F.max("ratio").alias("ratio"))
