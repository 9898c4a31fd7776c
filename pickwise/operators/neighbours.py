"""Exact neighbours of a stated set of queries among all exemplars, and what is made of them.

Queries and exemplars are packed into blocks of bounded size; each pair of blocks is one matrix product, of which a query
keeps its k nearest; these meet in one ranking by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.vectors import unit


def packed(df: DataFrame, key: str, block: str, rows: int) -> tuple[DataFrame, int]:
    """block, ids, vectors: the rows' unit vectors in blocks of about `rows`; and the number of blocks."""
    n = max(1, -(-df.count() // rows))
    b = df.select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(block), F.struct(F.col(key).cast("long").alias("id"), unit(F.col("embedding")).alias("v")).alias("r"))
    g = b.groupBy(block).agg(F.collect_list("r").alias("r"))
    return g.select(block, F.col("r.id").alias(f"{block}_ids"), F.flatten("r.v").alias(f"{block}_x")), n


def nearest(queries: DataFrame, profile: DataFrame, k: int = fixed.NEIGHBOURS, exclude_self: bool = True, block_rows: int = 2048) -> DataFrame:
    """query_id, exemplar_id, similarity (cosine), rank: the k nearest of profile(exemplar_id, embedding) for each of
    queries(query_id, embedding); vectors are of one length. Equal similarities (to 12 places) go by exemplar_id."""
    q, n_q = packed(queries, "query_id", "q", block_rows)
    p, _ = packed(profile, "exemplar_id", "p", block_rows)
    pairs = p.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).join(q, "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: np.asarray(batch.column(name)[row].values)  # noqa: B023, E731
                own, ids = get("q_ids"), get("p_ids")
                x, y = get("q_x").reshape(len(own), -1), get("p_x").reshape(len(ids), -1)
                for lo in range(0, len(own), 256):
                    s = x[lo : lo + 256] @ y.T
                    if exclude_self:
                        s[own[lo : lo + 256][:, None] == ids[None]] = -np.inf
                    r = np.round(s, 12)
                    for i in range(len(s)):
                        near = np.flatnonzero(r[i] >= np.partition(r[i], -k)[-k]) if len(ids) > k else np.arange(len(ids))
                        near = near[np.isfinite(s[i][near])]
                        near = near[np.lexsort((ids[near], -r[i][near]))[:k]]
                        yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.full(len(near), own[lo + i])), "exemplar_id": pa.array(ids[near]), "similarity": pa.array(s[i][near])})

    found = pairs.select("q_ids", "q_x", "p_ids", "p_x").mapInArrow(run, "query_id long, exemplar_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "exemplar_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def softmax_weights(top: DataFrame, temperature: float = fixed.TEMPERATURE) -> DataFrame:
    """Adds weight: softmax of each query's similarities."""
    w = Window.partitionBy("query_id")
    e = F.exp((F.col("similarity") - F.max("similarity").over(w)) / temperature)
    return top.withColumn("e", e).withColumn("weight", F.col("e") / F.sum("e").over(w)).drop("e")


def style_score(queries: DataFrame, profile: DataFrame, k: int = fixed.NEIGHBOURS, temperature: float = fixed.TEMPERATURE, exclude_self: bool = True) -> DataFrame:
    """query_id, style: the softmax-weighted mean of the k largest similarities."""
    top = softmax_weights(nearest(queries, profile, k, exclude_self), temperature)
    return top.groupBy("query_id").agg(F.sum(F.col("weight") * F.col("similarity")).alias("style"))


def contrastive(positive: Column, negative: Column, weight: float = fixed.NEGATIVE_WEIGHT) -> Column:
    """The positive score less what the negative exceeds it by; no negative: the positive."""
    return positive - weight * F.greatest(F.lit(0.0), F.coalesce(negative - positive, F.lit(0.0)))


def centroid(df: DataFrame, by: str, weight: Column | None = None) -> DataFrame:
    """by, centroid: the weighted mean of unit vectors, made a unit vector; element sums by place, nothing gathered."""
    w = weight if weight is not None else F.lit(1.0)
    parts = df.select(by, w.alias("w"), F.posexplode(unit(F.col("embedding"))).alias("place", "x"))
    mean = parts.groupBy(by, "place").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    whole = mean.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("s"))  # as long as a vector
    return whole.select(by, unit(F.col("s.x")).alias("centroid"))
