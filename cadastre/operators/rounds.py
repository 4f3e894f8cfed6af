"""Order-dependent selections and components, solved in rounds over pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cadastre.session import cut_lineage, joined_by_sorting

#: pairs from which a checkpointed table is too large to go through the driver
MANY_PAIRS = 250_000


def greedy_dropped(pairs: DataFrame) -> DataFrame:
    """Ids a sequential "keep unless a kept stronger one forbids it" pass would drop.

    ``pairs``: (strong, weak), strong comes first in the order. A node no open pair names as weak is
    certainly kept; what it forbids is certainly dropped; both leave the table. The result does not
    depend on partitioning. Rounds follow the longest chain of decisions, and the table shrinks in each;
    only pairs that form a cycle could stop that, which no order has.
    """
    open_pairs = cut_lineage(pairs.select("strong", "weak").distinct())
    dropped = []
    while left := open_pairs.count():
        open_pairs = joined_by_sorting(open_pairs) if left > MANY_PAIRS else open_pairs
        weak = open_pairs.select(F.col("weak").alias("strong")).distinct()
        decided = open_pairs.join(weak, "strong", "left_anti")
        gone = cut_lineage(decided.select("weak").distinct())
        if gone.isEmpty():
            raise RuntimeError("the pairs form a cycle")
        dropped.append(gone)
        lost = gone.withColumnRenamed("weak", "strong")
        # the pairs of a kept node all point at dropped nodes, so these two joins remove them too
        open_pairs = cut_lineage(open_pairs.join(gone, "weak", "left_anti").join(lost, "strong", "left_anti"))
    out = open_pairs.select("weak")
    for part in dropped:
        out = out.unionByName(part)
    return out.withColumnRenamed("weak", "id")


def keep_strongest_copies(df: DataFrame, geometry: list[str], order: Column, key: str) -> DataFrame:
    """One row per identical geometry, the first in the order.

    Copies always suppress each other, so only the first can survive; removing the rest beforehand
    keeps a large group of copies from producing all its pairs.
    """
    first = df.groupBy(*geometry).agg(F.min_by(F.struct(*df.columns), order).alias("r"))
    return first.select("r.*")


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id for every node of (u, v) pairs: alternating star contraction until it settles.

    The pairs are counted in each round; many of them are joined by sorting.
    """

    def star(e: DataFrame, larger: bool, pairs: int) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = joined_by_sorting(both) if pairs > MANY_PAIRS else both
        hub = both if larger else both.where("v <= u")
        low = hub.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        moved = hub.join(low, "u")
        if larger:
            return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def fingerprint(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    current = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = fingerprint(current)
    while True:
        step = cut_lineage(star(star(current, True, seen[0]), False, seen[0]))
        now = fingerprint(step)
        if now == seen:
            labels = step.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
            roots = step.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
            return labels.unionByName(roots)
        current, seen = step, now
