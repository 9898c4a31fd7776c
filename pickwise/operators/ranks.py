"""Places and quantiles over large groups: counts by coarse buckets first, so that no task puts a whole group in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def place(df: DataFrame, by: list[str], bucket: Column, order: list[Column], name: str = "place") -> DataFrame:
    """Adds each row's place (from 0) in its group's order. `bucket` never falls along that order and is not null; one task
    orders one bucket, and one the counts of a group's buckets."""
    b = df.withColumn("_b", bucket)
    counts = b.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_k"))
    counts = counts.withColumn("_base", F.sum("_k").over(Window.partitionBy(*by).orderBy("_b")) - c("_k")).drop("_k")
    keys = [*by, "_b"]
    counts = counts.withColumnsRenamed({k: f"_r{k}" for k in keys})
    same = [c(k).eqNullSafe(c(f"_r{k}")) for k in by] + [c("_b") == c("_r_b")]
    j = b.join(counts, same)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return j.withColumn(name, (c("_base") + nth).cast("long")).drop("_base", *(f"_r{k}" for k in keys)).drop("_b")


STEPS = 1024  # buckets of a group; their edges come from a mergeable sketch of bounded size


def by_value(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds _bucket, which never falls along the value, and _n, the group's rows; null values go.

    Edges are approximate quantiles of each group, so a bucket holds about a share of 1 / STEPS of its group whatever the
    spread of the values, apart from rows of one equal value.
    """
    marks = F.array(*[F.lit(k / STEPS) for k in range(1, STEPS)])
    stats = df.groupBy(*by).agg(F.percentile_approx(value, marks, 10 * STEPS).alias("_edges"), F.count(value).alias("_n"))
    own = df.where(c(value).isNotNull())
    j = own.join(stats, by) if by else own.crossJoin(F.broadcast(stats))  # one row
    # How many edges do not lie above the value, by halving.
    halves = F.array(*[F.lit(STEPS >> k) for k in range(1, STEPS.bit_length())])
    found = F.aggregate(halves, F.lit(0), lambda at, s: F.when(F.get("_edges", at + s - 1) <= c(value), at + s).otherwise(at))
    return j.withColumn("_bucket", found).drop("_edges")


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """by and, for each name, the value at that place (from 0) in order; ranks are of _n, the group's number of values.

    Only the buckets that hold a wanted place are put in order, and in these equal values are one row with a count.
    """
    b = by_value(df.select(*by, value), by, value)
    counts = b.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_k"), F.first("_n").alias("_n"))
    counts = counts.withColumn("_base", F.sum("_k").over(Window.partitionBy(*by).orderBy("_bucket")) - c("_k"))  # STEPS rows a group
    want = counts.select(*by, "_bucket", "_base", "_k", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])).alias("w"))
    want = want.where(c("w.rank").between(c("_base"), c("_base") + c("_k") - 1)).select(*by, "_bucket", c("w.name").alias("_name"), (c("w.rank") - c("_base")).alias("_at"))
    keys = [*by, "_bucket"]
    some = b.join(want.select(*keys).distinct(), keys).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    some = some.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy(value)))
    found = some.join(want, keys).where((c("_at") < c("_upto")) & (c("_at") >= c("_upto") - c("_c")))
    return found.groupBy(*by).agg(*[F.max(F.when(c("_name") == k, c(value))).alias(k) for k in ranks])


def quantiles(df: DataFrame, value: str, wanted: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """by and interpolated quantiles of a column's values; one row without `by`."""
    by, place = by or [], lambda p: (c("_n") - 1) * p
    low, high = {f"{k}_lo": F.floor(place(p)) for k, p in wanted.items()}, {f"{k}_hi": F.ceil(place(p)) for k, p in wanted.items()}
    r, n = at_ranks(df, by, value, low | high), df.groupBy(*by).agg(F.count(value).alias("_n"))
    r = r.join(n, by) if by else r.crossJoin(F.broadcast(n))  # one row each
    return r.select(*by, *[(c(f"{k}_lo") + (c(f"{k}_hi") - c(f"{k}_lo")) * (place(p) - F.floor(place(p)))).alias(k) for k, p in wanted.items()])
