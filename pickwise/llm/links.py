"""Connected components of a table of links, and what near-copy operators do with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, maybe_broadcast, save

BROADCAST = 200_000  # rows of a few longs that a join may send to every executor


def neighbours(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Pairs a < b of nodes of rows(*keys, node): each with the one before it in this order among those of equal keys.

    Keys with more than `most` rows are cut into parts that are put in order each for itself, and the parts' first rows
    are paired too, so no task holds a whole large group. Null keys are not expected.
    """
    large = save(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > most), "large")
    cut = rows.join(maybe_broadcast(large, large.count(), BROADCAST), keys, "left")
    cut = cut.withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / most)), F.lit(0)))
    within = Window.partitionBy(*keys, "part").orderBy(*order)
    cut = cut.withColumns({"before": F.lag("node").over(within), "nth": F.row_number().over(within)})
    heads = cut.where((F.col("nth") == 1) & F.col("members").isNotNull()).withColumn("before", F.lag("node").over(Window.partitionBy(*keys).orderBy(*order)))
    pairs = cut.select("before", "node").union(heads.select("before", "node")).where(F.col("before").isNotNull())
    return pairs.select(F.least("before", "node").alias("a"), F.greatest("before", "node").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs -> (node, component): component is the smallest node reachable; nodes without links are absent.

    Contraction: in each round every node hooks to whichever of itself and its neighbours has the smallest hash of that
    round, and links move to the hooks. A round leaves a fraction of the links' ends, so rounds grow with the logarithm
    of the longest chain. All of it is joins and aggregates by node; nothing is gathered on the driver.
    """
    edges = save(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels, turn = None, 0
    while not edges.isEmpty():
        key = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        ends = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        hook = save(ends.groupBy("a").agg(F.min(key("b")).alias("k")).select(F.col("a").alias("v"), F.least(F.col("k"), key("a"))["v"].alias("hook")), "hooks")
        if labels is None:
            new = save(hook.select(F.col("v").alias("node"), F.col("hook").alias("root")), "labels")
        else:
            new = save(labels.join(hook, labels["root"] == hook["v"], "left").select("node", F.coalesce("hook", "root").alias("root")), "labels")
            discard(labels)
        a, b = hook.withColumnsRenamed({"v": "a", "hook": "x"}), hook.withColumnsRenamed({"v": "b", "hook": "y"})
        moved = edges.join(a, "a").join(b, "b").where(F.col("x") != F.col("y"))
        smaller = save(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        discard(edges, hook)
        labels, edges, turn = new, smaller, turn + 1
    if labels is None:
        none = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        none.scratch_path = edges.scratch_path
        return none
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    out = save(labels.join(least, "root").select("node", "component"), "components")
    discard(labels, edges)
    return out
