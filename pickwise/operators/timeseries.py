"""Time series in batch: counter rates, positional downsampling, overlap, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import place


def seconds(ts: Column) -> Column:
    """Seconds since the epoch, with fractions; the session's zone must be UTC for zone-less times."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def counter_rate(df: DataFrame, by: list[str], order: list[str], ts: str, counter: str) -> DataFrame:
    """rate: growth a second since the row before; null for a first row, a reset, or no time between."""
    w = Window.partitionBy(*by).orderBy(*order)
    before, gap = F.lag(counter).over(w), seconds(F.col(ts)) - F.lag(seconds(F.col(ts))).over(w)
    return df.withColumn("rate", F.when((gap > 0) & (F.col(counter) >= before), (F.col(counter) - before) / gap))


def downsample(df: DataFrame, by: list[str], order: list[str], points: int, value: str, ts: str, coarse: Column | None = None, peak: str | None = None) -> DataFrame:
    """At most `points` buckets of equal numbers of rows in order: bucket, rows, mean (nulls skipped), and the time of the
    middle row; with `peak`, also that column's largest value (0 without any). Buckets go by position, not by time; series of `points` rows or fewer have a bucket for each row.

    `coarse` is a value that never falls along the order (such as the day): with it, one task orders one such value's rows
    of a series; without it, a whole series.
    """
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    at = place(df, by, coarse if coarse is not None else F.lit(0), [F.col(o) for o in order], "_at").join(n, by)
    size = F.greatest(F.ceil(F.col("_n") / points), F.lit(1))
    b = at.withColumns({"bucket": F.floor(F.col("_at") / size).cast("long"), "_pos": (F.col("_at") % size).cast("long"), "_rows": F.least(size, F.col("_n") - F.floor(F.col("_at") / size) * size)})
    middle = F.max(F.when(F.col("_pos") == F.least(F.col("_rows") - 1, F.floor(F.col("_rows") / 2)), F.col(ts)))
    more = [F.coalesce(F.max(peak), F.lit(0)).alias("peak")] if peak else []
    return b.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(value), 3).alias("mean"), middle.alias("ts"), *more)


def overlaps(start: Column, finish: Column, low: Column, high: Column) -> Column:
    """Whether [start, finish or still running] meets [low, high]."""
    return (start <= high) & (F.coalesce(finish, high) >= low)


def minute_bucket(ts: Column, minutes: int) -> Column:
    """The start of the row's bucket in whole epoch minutes."""
    m = F.floor(seconds(ts) / 60)
    return (m - m % minutes).cast("long")


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the pace so far; null without progress or without a total."""
    return F.when((done > 0) & (elapsed > 0) & (total >= done), (total - done) / (done / elapsed))
