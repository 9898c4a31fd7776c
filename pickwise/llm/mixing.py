"""Mixing sources to target weights by Pareto order sampling.

Sources weigh 1, 2, 3, 1, 2, ... in code-point order of their names (null last) and share the words of the whole corpus;
no target passes `max_repeat` times its source. Every document of a source first gets the whole copies that the
source's ratio target / size allots for certain. The rest is a fixed-size sample: documents are ranked by
(u / (1 - u)) / (p / (1 - p)) with u a hash of doc_id and p the inclusion probability, and taken in that order until
the source's remaining words are reached; the document that crosses the line is taken if that ends nearer to it.

Inclusion probabilities are unequal: p = rest * merit / sum(merit * size) over the source (kept inside (0, 1)), so that the
expected words are the source's remaining ones. Merit is a whole number; by default floor(16 * sqrt(size)), so longer
documents are likelier to be in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, maybe_broadcast, save

EDGE = 1e-9


def allot(sources: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """source, source_size -> target by filling up: capped sources are those with the smallest cap / weight.

    One task puts the sources in order, one row each: names of sources are few beside their documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pos = (F.row_number().over(order) - 1) % len(weights)
    s = sources.select("source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), (pos + 1).cast("int")).cast("long").alias("weight"))
    s = s.withColumn("cap", F.col("source_size") * max_repeat)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    s = s.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("level", F.max(F.when(F.col("fits"), F.col("level"))).over(every))  # levels fall once the right sources are capped
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def uniform(doc_id: Column, seed: str) -> Column:
    """A reproducible number in (0, 1) of the document's id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: str = "mix", merit: Column | None = None, bucket_rows: int = 2000) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs(doc_id, text, source).

    Null or wordless texts have size 0 and taken 0; a null source is a source of its own (the last); rows with equal
    doc_id share one random number and are taken in order of size. An empty table gives an empty result; an empty
    corpus (no words) gives targets 0. Only doc_id, text, source and what `merit` names are read; a merit may use `size`, a
    null one counts as 1, one below 1 as 1.
    No task sees a whole source: ranks are cut into buckets of about `bucket_rows` documents, bucket sums find the one
    bucket where the source's target is met, and only that bucket's documents are put in exact order.
    """
    spark = docs.sparkSession
    merit = F.floor(16 * F.sqrt(F.col("size"))) if merit is None else merit
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    sizes = save(sized.select("doc_id", "source", "size", F.greatest(F.coalesce(merit.cast("long"), F.lit(1)), F.lit(1)).cast("long").alias("merit")), "mix")
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"), F.sum(F.col("size") * F.col("merit")).alias("valued")).persist()
    n_sources = stats.count()
    most = stats.agg(F.max("docs")).first()[0] or 0
    buckets = 1 << max(4, (most // bucket_rows).bit_length())
    src = allot(stats.select("source", "source_size"), weights, max_repeat).alias("a")
    src = src.join(stats.select(F.col("source").alias("s2"), "valued"), F.col("a.source").eqNullSafe(F.col("s2"))).drop("s2")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    src = src.select("source", "source_size", "target", "valued", F.floor(ratio).cast("long").alias("whole"))
    src = src.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    src = save(src, "mix-sources").cache()
    stats.unpersist()
    j = sizes.join(maybe_broadcast(src.withColumnRenamed("source", "s"), n_sources), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    p = F.least(F.greatest(F.when(F.col("valued") > 0, F.col("rest") * F.col("merit") / F.col("valued")).otherwise(0.0), F.lit(EDGE)), F.lit(1 - EDGE))
    u = uniform(F.col("doc_id"), seed)
    rank = (u / (1 - u)) / (p / (1 - p))
    ranked = j.withColumn("rank", rank).withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * buckets).cast("int"))
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    up = Window.partitionBy("source").orderBy("bucket")  # a source's buckets: one for bucket_rows of its documents
    sums = sums.withColumn("upto", F.sum("words").over(up))
    # A source that gets whole copies only has no edge: none of its documents is sampled, and none need be put in order.
    edge = sums.where((F.col("rest") > 0) & (F.col("upto") > F.col("rest"))).groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")), "bucket").alias("edge"))
    edge = edge.select(F.col("source").alias("s"), F.col("edge.bucket").alias("edge_bucket"), F.col("edge.before").alias("before"))
    marked = ranked.join(maybe_broadcast(edge, n_sources), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    sure = (F.col("rest") > 0) & F.coalesce(F.col("bucket") < F.col("edge_bucket"), F.lit(True))
    out = ["doc_id", "source", "size", "source_size", "target"]
    done = marked.where(F.coalesce(F.col("bucket") != F.col("edge_bucket"), F.lit(True))).select(*out, (F.col("size") * (F.col("whole") + sure.cast("long"))).alias("taken"))
    line = Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    last = marked.where(F.col("bucket") == F.col("edge_bucket")).withColumn("cum", F.col("before") + F.sum("size").over(line))
    pick = (F.col("cum") <= F.col("rest")) | ((F.col("cum") - F.col("size") <= F.col("rest")) & (F.col("cum") - F.col("rest") < F.col("rest") - (F.col("cum") - F.col("size"))))
    return done.unionByName(last.select(*out, (F.col("size") * (F.col("whole") + pick.cast("long"))).alias("taken")))


ORACLE = r"""
WITH d AS (SELECT *, greatest(CAST(floor(16 * sqrt(size)) AS BIGINT), 1) AS merit FROM (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents)),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * merit) AS BIGINT) AS valued FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s0),
s2 AS (SELECT *, 3 * source_size AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
  (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open_weight FROM s2),
s4 AS (SELECT *, (total - capped)::DOUBLE / open_weight::DOUBLE AS level FROM s3),
s5 AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS lvl FROM s4),
s6 AS (SELECT source, source_size, valued, least(cap::DOUBLE, lvl * weight) AS target FROM s5),
s7 AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM s6),
s8 AS (SELECT *, target - whole * source_size AS rest FROM s7),
j0 AS (SELECT d.doc_id, d.size, d.merit, s8.*, (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN s8 ON d.source IS NOT DISTINCT FROM s8.source),
j1 AS (SELECT *, least(greatest(CASE WHEN valued > 0 THEN rest * merit / valued ELSE 0 END, 1e-9), 1 - 1e-9) AS p FROM j0),
j AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS rank FROM j1),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cum FROM j)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN rest > 0 AND (cum <= rest OR (cum - size <= rest AND cum - rest < rest - (cum - size))) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
