"""Problem 7: filling containers of fixed capacity by conflict-constrained best fit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, ship
from .common import spread, table
from .tokens import VOCABULARY, token_sizes

SHARD_ITEMS = 20000


class Bins:
    """Open bins ordered by residual: for each residual the bins that have it, and one integer whose set bits are
    the residuals in use, so that the next larger residual is found by bit operations."""

    def __init__(self, capacity: int, source_slack: float = 1 / 64) -> None:
        self.capacity = capacity
        self.slack = capacity * source_slack
        self.at: list[dict[int, None]] = [{} for _ in range(capacity + 1)]  # in order of arrival
        self.used = 0
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _put(self, b: int) -> None:
        r = self.residual[b]
        self.at[r][b] = None
        self.used |= 1 << r

    def _take(self, b: int) -> None:
        r = self.residual[b]
        del self.at[r][b]
        if not self.at[r]:
            self.used &= ~(1 << r)

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin for an item; ``source`` and ``cluster`` are bits (0: none).

        From the tightest residual upwards, the first bin without a copy of the item and without another item
        of its source is taken; if there is none, the tightest without a copy; else a new bin is opened. Copies are
        a hard conflict: the search goes on until a bin without one is found. Sources are a soft one: a bin that has
        the source already is passed over only for bins looser by up to ``source_slack`` of the capacity.
        """
        fallback = -1
        rest = self.used >> size
        r = size - 1
        found = -1
        while rest and found < 0:
            step = (rest & -rest).bit_length()
            rest >>= step
            r += step
            for b in self.at[r]:
                if self.clusters[b] & cluster:
                    continue
                if not self.sources[b] & source:
                    found = b
                    break
                if fallback < 0:
                    fallback = b
            if fallback >= 0 and found < 0 and r - self.residual[fallback] > self.slack:
                break  # a looser bin would cost more space than a mixed source is worth
        if found < 0:
            found = fallback
        if found < 0:
            found = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self._take(found)
        self.residual[found] -= size
        self.sources[found] |= source
        self.clusters[found] |= cluster
        if self.residual[found]:
            self._put(found)
        return found


def pack(items: list[tuple], capacity: int, source_slack: float = 1 / 64) -> list[int]:
    """Bin number of each (size, source, cluster) item, largest first; ties keep their order. Sizes 1 to capacity."""
    bins = Bins(capacity, source_slack)
    source_bit: dict = {}
    count: dict = {}
    for _, _, c in items:
        count[c] = count.get(c, 0) + 1
    cluster_bit: dict = {}
    out = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        size, s, c = items[i]
        sb = 1 << source_bit.setdefault(s, len(source_bit))
        cb = 1 << cluster_bit.setdefault(c, len(cluster_bit)) if c is not None and count[c] > 1 else 0
        out[i] = bins.place(size, sb, cb)
    return out


def fill_containers(sizes: DataFrame, capacity: int, shard_items: int = SHARD_ITEMS, source_slack: float = 1 / 64) -> DataFrame:
    """container_id, key, piece_no, token_start, token_end: every item in a container of ``capacity`` tokens.

    ``sizes`` has key, source, n_tokens, cluster. An item is split only if it alone exceeds the capacity, into
    pieces of the whole capacity and a rest. Items of no tokens (null or empty text) need no container and give
    no row. Copies of one text (equal ``cluster``) never share a container; items of one source share one only
    where another would leave more than ``source_slack`` of the capacity further unused (1: wherever any other fits). Re-delivered keys must be merged before.

    Whole pieces fill a container each and are never gathered. The rest is dealt into shards by hash of the key,
    about ``shard_items`` items each, so a task's group is bounded and a hot source is spread evenly; each shard is
    packed by itself, which costs at most one badly filled container a shard.
    """
    ship(sizes.sparkSession)
    kind = dict(sizes.dtypes)["key"]
    items = sizes.where("n_tokens > 0")
    whole = items.where(F.col("n_tokens") >= capacity).select("key", "n_tokens", F.explode(F.sequence(F.lit(0), F.expr(f"cast(n_tokens div {capacity} as int) - 1"))).alias("piece_no"))
    whole = whole.select(
        F.concat_ws("-", F.lit("w"), F.col("key").cast("string"), "piece_no").alias("container_id"), "key", "piece_no", (F.col("piece_no") * capacity).alias("token_start"), ((F.col("piece_no") + 1) * capacity).alias("token_end")
    )
    rest = items.where(F.col("n_tokens") % capacity > 0).select("key", "source", "cluster", F.expr(f"cast(n_tokens div {capacity} as int)").alias("piece_no"), F.expr(f"cast(n_tokens % {capacity} as int)").alias("size"), "n_tokens")
    shards = max(1, -(-rest.count() // shard_items))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        clusters = pdf["cluster"].astype("object").where(pdf["cluster"].notna(), None)
        bins = pack(list(zip(pdf["size"].tolist(), pdf["source"].tolist(), clusters.tolist())), capacity, source_slack)
        shard = int(pdf["shard"].iloc[0])
        return pd.DataFrame(
            {"container_id": [f"s{shard}-{b}" for b in bins], "key": pdf["key"], "piece_no": pdf["piece_no"].astype("int32"), "token_start": (pdf["n_tokens"] - pdf["size"]).astype("int32"), "token_end": pdf["n_tokens"].astype("int32")}
        )

    packed = rest.groupBy("shard").applyInPandas(run, f"container_id string, key {kind}, piece_no int, token_start int, token_end int")
    return whole.unionByName(packed)


def document_sizes(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return cut(token_sizes(docs, "doc_id", "text", keep=("source",), path=vocabulary))


def _all(spark, sf_dir: str) -> DataFrame:
    sizes = document_sizes(spark, sf_dir)
    out = None
    for c in table(spark, sf_dir, "container_sizes").collect():  # three rows
        part = fill_containers(sizes, c.capacity_tokens).withColumn("container_name", F.lit(c.container_name)).withColumn("capacity_tokens", F.lit(c.capacity_tokens))
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("key", "doc_id")


def p7_containers(spark, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir)


def p7_fill(spark, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share of each capacity."""
    a = _all(spark, sf_dir).groupBy("container_name", "capacity_tokens").agg(F.count_distinct("container_id").alias("containers"), F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"), F.count("*").alias("pieces"))
    return a.withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
SQL: dict[str, str] = {}
