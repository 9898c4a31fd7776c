"""Candidate dataflow: gates, ranking, stacks, duplicates, outputs. Every function takes and returns DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, scores
from ..functions.vectors import dot, unit
from ..sources.scratch import dropped, kept


def gate(df: DataFrame, personalised: bool = True, junk: bool = False) -> DataFrame:
    """gate_reason: the first gate that rejects the row, or null."""
    c = F.col
    first = F.coalesce(scores.metadata_reason(c("width")), scores.style_reason(c("aesthetic"), c("knn_sim"), personalised), scores.junk_reason(c("aesthetic"), c("provenance"), c("resolution"), junk))
    return df.withColumn("gate_reason", first)


def rank(df: DataFrame, by: str = "subject", score: str = "score", tie: str = "candidate_id", name: str = "rank") -> DataFrame:
    """Ranks 1.. in each subject, best score first, equal scores by the tie column."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc_nulls_last(), tie)).cast("long"))


def exact_duplicates(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """kept_id and is_kept: of rows equal in `group` the first in `order` is kept."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("kept_id", F.first("candidate_id").over(w)).withColumn("is_kept", F.col("kept_id") == F.col("candidate_id"))


def average_linkage(pairs: DataFrame, members: DataFrame, threshold: float, by: str = "subject") -> DataFrame:
    """by, id, cluster (the smallest id in it): average linkage of members(by, id) by pairs(by, a, b, similarity), a < b, all
    pairs of a subject: the two clusters of highest mean similarity merge while that reaches the threshold.

    In each round all clusters merge that are each other's nearest, in all subjects at once; as a mean of both parts'
    similarities never beats the nearer of them, that gives the clusters of merging one pair at a time. Equally near
    clusters go by the smallest id.
    """
    label = kept(members.select(by, "id", F.col("id").alias("cluster")), "clusters")
    s = kept(pairs.select(by, "a", "b", F.col("similarity").alias("sum"), F.lit(1).cast("long").alias("n")), "similarities")
    while True:
        mean = F.col("sum") / F.col("n")
        both = s.select(by, "a", "b", mean.alias("m")).union(s.select(by, "b", "a", mean)).where(F.col("m") >= threshold)
        near = both.groupBy(by, "a").agg(F.min(F.struct((-F.col("m")).alias("m"), "b"))["b"].alias("b"))
        other = near.select(by, F.col("a").alias("b"), F.col("b").alias("back"))
        merged = kept(near.join(other, [by, "b"]).where((F.col("a") < F.col("b")) & (F.col("back") == F.col("a"))).select(by, F.col("b").alias("gone"), F.col("a").alias("into")), "merged")
        if merged.isEmpty():
            dropped(merged, s)
            return label
        move = lambda df, name: df.join(merged.withColumnRenamed("gone", name), [by, name], "left").withColumn(name, F.coalesce("into", name)).drop("into")
        new = move(move(s, "a"), "b").where("a <> b").groupBy(by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
        new_s, new_label = kept(new, "similarities"), kept(move(label, "cluster").select(by, "id", "cluster"), "clusters")
        dropped(s, label, merged)
        s, label = new_s, new_label


def stacks(df: DataFrame, threshold: float = fixed.STACK_MIN_SIMILARITY, top: int = fixed.STACK_TOP, by: str = "subject") -> DataFrame:
    """subject, candidate_id, score, stack_rank, stack_pos, stack_label, stack_size, stack_score.

    df has subject, candidate_id, score, embedding; rows of a subject (a bounded set of candidates) are clustered by
    cosine. A null embedding is a stack of its own. Members go by score, stacks by the mean of their best `top`, then
    their best, then size, then the smallest id.
    """
    own = df.select(by, "candidate_id", F.coalesce("score", F.lit(0.0)).alias("score"), unit(F.col("embedding").cast("array<double>")).alias("e"))
    x, y = own.where("e is not null").select(by, F.col("candidate_id").alias("a"), F.col("e").alias("x")), own.where("e is not null").select(by, F.col("candidate_id").alias("b"), F.col("e").alias("y"))
    pairs = x.join(y, by).where("a < b").select(by, "a", "b", dot(F.col("x"), F.col("y")).alias("similarity"))
    found = average_linkage(pairs, own.select(by, F.col("candidate_id").alias("id")), threshold, by)
    clustered = own.drop("e").join(found.withColumnRenamed("id", "candidate_id"), [by, "candidate_id"])
    inside = Window.partitionBy(by, "cluster").orderBy(F.desc("score"), "candidate_id")
    whole = Window.partitionBy(by, "cluster")
    ranked = clustered.withColumn("stack_pos", F.row_number().over(inside).cast("long"))
    ranked = ranked.withColumns({"stack_size": F.count(F.lit(1)).over(whole), "stack_score": F.avg(F.when(F.col("stack_pos") <= top, F.col("score"))).over(whole), "best": F.max("score").over(whole), "head": F.min("candidate_id").over(whole)})
    order = Window.partitionBy(by).orderBy(F.desc("stack_score"), F.desc("best"), F.desc("stack_size"), "head")
    return ranked.withColumn("stack_rank", F.dense_rank().over(order).cast("long")).withColumn("stack_label", scores.position_label(F.col("stack_pos"))).select(by, "candidate_id", "score", "stack_rank", "stack_pos", "stack_label", "stack_size", "stack_score")


FEW = 128  # hashes of a subject that are compared with each other


def near_hashes(nodes: DataFrame, most: int, by: str) -> DataFrame:
    """by, a, b: pairs a before b of nodes(by, id, phash) that differ in `most` bits at most. The 64 bits are cut into
    most + 2 bands; such a pair agrees in two of them, so each pair of bands is one key of an index. A subject of few hashes
    is one key: its rows are not repeated for each pair of bands."""
    edges = [64 * k // (most + 2) for k in range(most + 3)]
    band = lambda k: F.shiftrightunsigned("phash", edges[k]).bitwiseAND((1 << (edges[k + 1] - edges[k])) - 1)
    keys = [F.struct(F.lit(n).alias("k"), band(i).alias("x"), band(j).alias("y")) for n, (i, j) in enumerate(combinations(range(most + 2), 2))]
    one = F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    sized = nodes.join(nodes.groupBy(by).agg(F.count(F.lit(1)).alias("members")), by)
    index = sized.select(by, "id", "phash", F.explode(F.when(F.col("members") <= FEW, F.array(one)).otherwise(F.array(*keys))).alias("key")).select(by, "id", "phash", "key.*")
    other = index.select(by, F.col("id").alias("b"), F.col("phash").alias("other"), "k", "x", "y")
    close = index.join(other, [by, "k", "x", "y"]).where((F.col("id") < F.col("b")) & (F.bit_count(F.col("phash").bitwiseXOR(F.col("other"))) <= most))
    return close.select(by, F.col("id").alias("a"), "b").distinct()


def first_independent(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """by, id of the nodes that a walk in order of id takes if it skips all neighbours of those taken; edges(by, a, b), a < b.

    In rounds: nodes without open earlier neighbours are taken, their neighbours go. Rounds follow the longest chain of
    nodes that wait for each other.
    """
    open_, left, taken = kept(nodes.select(by, "id"), "open"), kept(edges, "edges"), None
    while not open_.isEmpty():
        free = kept(open_.join(left.select(by, F.col("b").alias("id")).distinct(), [by, "id"], "left_anti"), "free")
        gone = kept(left.join(free.withColumnRenamed("id", "a"), [by, "a"], "left_semi").select(by, F.col("b").alias("id")).distinct(), "gone")
        over = free.unionByName(gone)
        new_open = kept(open_.join(over, [by, "id"], "left_anti"), "open")
        new_left = kept(left.join(over.withColumnRenamed("id", "a"), [by, "a"], "left_anti").join(gone.withColumnRenamed("id", "b"), [by, "b"], "left_anti"), "edges")
        dropped(open_, left, gone)
        taken = free if taken is None else taken.unionByName(free)
        open_, left = new_open, new_left
    return taken if taken is not None else open_


def greedy_near_duplicates(df: DataFrame, most: int = fixed.PHASH_MAX_DISTANCE, by: str = "subject", prefer: tuple[str, ...] = ("pixels",)) -> DataFrame:
    """subject, candidate_id, anchor_id, kept_id, distance (to the kept one).

    In each subject, rows in order of candidate_id: each row not yet taken becomes an anchor and takes all later rows
    within `most` bits of it. Of a group the row is kept that is largest by the columns in `prefer`, one after another
    (nulls least), the first of equals. A null hash is a group of its own. Subjects may be of any size: equal hashes are
    one node, near ones meet in a banded index, and the anchors are the first independent set of the graph of near nodes.
    """
    rows = df.select(by, F.col("candidate_id").cast("long").alias("candidate_id"), F.col("phash").cast("long").alias("phash"), *prefer)
    nodes = kept(rows.where("phash is not null").groupBy(by, "phash").agg(F.min("candidate_id").alias("id")), "hashes")
    edges = kept(near_hashes(nodes, most, by), "near")
    anchors = first_independent(nodes, edges, by)
    takes = edges.join(anchors.withColumnRenamed("id", "a"), [by, "a"], "left_semi").groupBy(by, F.col("b").alias("id")).agg(F.min("a").alias("anchor_id"))
    of = nodes.join(takes, [by, "id"], "left").select(by, "phash", F.coalesce("anchor_id", "id").alias("anchor_id"))
    placed = rows.join(of, [by, "phash"], "left").withColumn("anchor_id", F.coalesce("anchor_id", "candidate_id"))
    best = placed.groupBy(by, "anchor_id").agg(F.max(F.struct(*prefer, (-F.col("candidate_id")).alias("back"), F.col("phash").alias("kept_hash"))).alias("best"))
    out = placed.join(best.select(by, "anchor_id", (-F.col("best.back")).alias("kept_id"), "best.kept_hash"), [by, "anchor_id"])
    return out.select(by, "candidate_id", "anchor_id", "kept_id", F.coalesce(F.bit_count(F.col("phash").bitwiseXOR(F.col("kept_hash"))), F.lit(0)).cast("long").alias("distance"))


def duplicate_ledger(found: DataFrame, by: str = "subject") -> DataFrame:
    """by, removed_id, kept_id, distance, reason of every row that is not kept: exact copies apart from near ones."""
    gone = found.where(F.col("candidate_id") != F.col("kept_id"))
    return gone.select(by, F.col("candidate_id").alias("removed_id"), "kept_id", "distance", F.when(F.col("distance") == 0, "dedup_exact").otherwise("dedup_phash").alias("reason"))


def suppress_overlaps(df: DataFrame, threshold: float = 0.5, by: str = "image", text: str | None = None) -> DataFrame:
    """Greedy suppression of boxes (image, box_id, confidence, left, top, right, bottom): the surest box stays and those
    that overlap it by at least the threshold go; with `text`, only those whose values of that column are equal. Rows of an image are a bounded set; equal confidences go by box_id."""

    c, side = F.col, lambda x, low, high: F.greatest(x[high] - x[low], F.lit(0.0))
    area = lambda x: side(x, "left", "right") * side(x, "top", "bottom")
    meet = lambda x, y, low, high: F.greatest(F.least(x[high], y[high]) - F.greatest(x[low], y[low]), F.lit(0.0))

    def over(x: Column, y: Column) -> Column:
        both = meet(x, y, "left", "right") * meet(x, y, "top", "bottom")
        union = area(x) + area(y) - both
        near = F.when(union > 0, both / union).otherwise(0.0) >= threshold
        return F.coalesce(near & x[text].eqNullSafe(y[text]) if text else near, F.lit(False))

    none = c("confidence").isNull() | F.isnan("confidence")
    box = F.struct(none.alias("_none"), F.when(~none, -c("confidence")).alias("_sure"), c("box_id").alias("_id"), F.struct(*df.columns).alias("x"))
    own = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by).groupBy(by).agg(F.sort_array(F.collect_list(box)).alias("own"))
    own = own.withColumn("own", F.transform("own", lambda b: b["x"]))
    empty = F.slice("own", 1, 0)
    stays = F.aggregate("own", empty, lambda found, y: F.when(F.exists(found, lambda x: over(x, y)), found).otherwise(F.concat(found, F.array(y))))
    return own.select(F.explode(stays).alias("x")).select("x.*")


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Matching-blocks ratio of two texts, 2 * matches / length of both."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in it:
            yield pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def only_if_none_accepted(df: DataFrame, accepted: str, fallback: str, by: str = "subject") -> DataFrame:
    """Accept fallback rows too, but only in subjects with no accepted row."""
    some = F.coalesce(F.bool_or(accepted).over(Window.partitionBy(by)), F.lit(False))
    return df.withColumn("final", F.col(accepted) | (~some & F.col(fallback)))
