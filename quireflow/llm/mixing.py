"""Problem 8: mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .common import table
from .packing import document_sizes

BUCKET_ROWS = 50000


def prefix_sum(df: DataFrame, groups: list[str], order: list, value: str, bucket, out: str) -> DataFrame:
    """Running sum of ``value`` within ``groups`` in the order given, without one task per group.

    ``bucket`` is an expression that does not fall along the order and has bounded buckets: sums of buckets are
    added up over the small table of buckets, running sums within a bucket over its rows.
    """
    d = df.withColumn("_b", bucket)
    sums = d.groupBy(*groups, "_b").agg(F.sum(value).alias("_s"))
    wide = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1) if groups else Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_b").alias("_bb"), F.coalesce(F.sum("_s").over(wide), F.lit(0)).alias("_before"))
    on = F.col("_b") == F.col("_bb")
    for i, g in enumerate(groups):
        on = on & (F.col(g) == F.col(f"_g{i}"))
    near = Window.partitionBy(*groups, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(before, on).withColumn(out, F.col("_before") + F.sum(value).over(near)).select(*df.columns, out)


def mix_sources(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 20250101, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """key, source, pass_no, n_tokens, finish_time, total: the records of the mixture in the order of finish time.

    ``sizes`` has key, source, n_tokens; ``targets`` source, target_share, max_repeats (a small table of fixed
    size). Within a source records come in a seeded random order, in up to ``max_repeats`` passes; a record's
    virtual finish time is the source's tokens so far over its target share. Records are taken in the order of
    finish time while their sum is within the budget. Without one, the budget is the largest for which no source
    runs out: the least of tokens x max_repeats / target_share. Records without tokens, of sources with no target
    or a share of 0 are not taken. ``total`` is the running sum.
    """
    rows = sizes.join(targets.where("target_share > 0 AND max_repeats > 0"), "source").where("n_tokens > 0").select("key", "source", "n_tokens", "target_share", "max_repeats")
    supply = rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.first("target_share").alias("w"), F.first("max_repeats").alias("r"), F.count("*").alias("n"), F.max("n_tokens").alias("m"))
    sources = [(float(x.w), x.t * x.r, x.m, x.n) for x in supply.collect()]  # as many rows as targets at most
    if budget is None:
        budget = int(min((t / w for w, t, _, _ in sources), default=0))
    buckets = max(1, -(-max((n for *_, n in sources), default=1) // bucket_rows))
    passes = rows.withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.col("max_repeats")))).withColumn("_h", F.xxhash64(F.lit(seed), "pass_no", "key"))
    # The order within a source is (pass, hash); a bucket is a range of hashes within a pass.
    bucket = F.col("pass_no") * F.lit(buckets) + F.floor((F.shiftrightunsigned("_h", 32) * F.lit(buckets)) / F.lit(float(2**32))).cast("long")
    order = [F.shiftrightunsigned("_h", 32), "_h", "key"]
    served = prefix_sum(passes, ["source"], order, "n_tokens", bucket, "served")
    timed = cut(served.select("key", "source", "pass_no", "n_tokens", (F.col("served") / F.col("target_share")).alias("finish_time")))
    last = latest_finish(sources, budget)
    near = timed.where(F.col("finish_time") <= F.lit(last))
    slices = max(1, -(-near.count() // bucket_rows))
    return prefix_sum(near, [], ["finish_time", "source", "pass_no", "key"], "n_tokens", _slice(sources, last, slices), "total").where(F.col("total") <= budget)


def latest_finish(sources: list[tuple[float, int, int, int]], budget: int) -> float:
    """A finish time after which no record can be within the budget, from (share, tokens, longest record, records).

    At time V a source has served its share of V, less one record at most, or all it has. The least V at which
    that sums to the budget is found by halving; sources that run out make it late, so it has no fixed bound."""
    end = max((t / w for w, t, _, _ in sources), default=0.0)
    surely = lambda v: sum(t if v * w >= t else max(0.0, v * w - m) for w, t, m, _ in sources)
    if surely(end) <= budget:
        return end
    lo, hi = 0.0, end
    for _ in range(64):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if surely(mid) > budget else (mid, hi)
    return hi


def _slice(sources: list[tuple[float, int, int, int]], last: float, slices: int):
    """Slice of a finish time, with about as many tokens in each: the tokens served by then, a line between at most
    32 of the times at which sources run out."""
    total = lambda v: sum(min(v * w, t) for w, t, _, _ in sources)
    ends = sorted({t / w for w, t, _, _ in sources if t / w < last})
    times = [0.0, *ends[:: max(1, -(-len(ends) // 32))], last]
    at, done = F.col("finish_time"), None
    for a, b in zip(times, times[1:]):
        line = F.lit(total(a)) + (at - F.lit(a)) * F.lit((total(b) - total(a)) / max(b - a, 1e-300))
        done = F.when(at <= F.lit(b), line) if done is None else done.when(at <= F.lit(b), line)
    return F.floor(done * F.lit(slices / max(total(last), 1e-300))).cast("long") if done is not None else F.lit(0)


def actual_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, records, most_repeats, tokens, actual_share for every target source."""
    uses = mixed.groupBy("source", "key").agg(F.count("*").alias("u"), F.sum("n_tokens").alias("t"))
    per = uses.groupBy("source").agg(F.sum("u").alias("records"), F.max("u").alias("most_repeats"), F.sum("t").alias("tokens"))
    whole = Window.partitionBy(F.lit(0))
    out = targets.join(per, "source", "left").fillna(0, ["records", "most_repeats", "tokens"])
    return out.select("source", "target_share", "max_repeats", "records", "most_repeats", "tokens", F.round(F.col("tokens") / F.greatest(F.sum("tokens").over(whole), F.lit(1)), 6).alias("actual_share"))


def p8_mixture(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(document_sizes(spark, sf_dir), table(spark, sf_dir, "source_targets"))
    return mixed.repartitionByRange("finish_time").sortWithinPartitions("finish_time", "source", "pass_no", "key").withColumnRenamed("key", "doc_id")


def p8_shares(spark, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "source_targets")
    return actual_shares(mix_sources(document_sizes(spark, sf_dir), targets), targets)


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
