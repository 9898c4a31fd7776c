"""How typical a value is of a profile: Gaussian density over the profile's own values, relative to its peak there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from . import ranks


def bands(samples: DataFrame, scale: float = 1.0, least: int = fixed.MIN_SAMPLES) -> DataFrame:
    """feature, n, median, p10, p90, bandwidth from samples(feature, value); features with under `least` values are absent."""
    own = samples.where(F.col("value").isNotNull() & ~F.isnan("value")).select("feature", "value")
    sums = own.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("value").alias("std"), F.max(F.abs("value")).alias("anchor")).where(F.col("n") >= least)
    q = ranks.quantiles(own, "value", {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}, ["feature"])
    s = sums.join(q, "feature")
    iqr = (F.col("p75") - F.col("p25")) / 1.349
    sigma = F.when((F.col("std") > 0) & (iqr > 0), F.least("std", iqr)).when(F.col("std") > 0, F.col("std")).when(iqr > 0, iqr).otherwise(0.0)
    width = F.when(sigma > 0, scale * 0.9 * sigma * F.pow("n", F.lit(-0.2))).otherwise(scale * F.greatest(0.05 * F.col("anchor"), F.lit(1e-3)))
    return s.select("feature", "n", F.col("p50").alias("median"), "p10", "p90", width.alias("bandwidth"))


def density(points: DataFrame, samples: DataFrame, band: DataFrame) -> DataFrame:
    """points plus density. points and samples have feature, value; equal values of a feature are counted once with
    weights, so work goes with distinct values."""
    weighted = samples.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(F.col("feature").alias("f"), F.col("value").alias("s")).agg(F.count(F.lit(1)).alias("w"))
    values = points.where(F.col("value").isNotNull() & ~F.isnan("value")).select("feature", "value").distinct().join(band, "feature")
    z = (F.col("value") - F.col("s")) / F.col("bandwidth")
    d = values.join(weighted, F.col("feature") == F.col("f")).groupBy("feature", "value").agg((F.sum(F.col("w") * F.exp(-0.5 * z * z)) / F.sum("w")).alias("density"))
    return points.join(d, ["feature", "value"])


def typicality(points: DataFrame, samples: DataFrame, scale: float = 1.0, least: int = fixed.MIN_SAMPLES) -> DataFrame:
    """points(…, feature, value) plus typicality in [0, 1]; points of uncalibrated features and null values are absent."""
    band = bands(samples, scale, least)
    peak = density(samples.select("feature", "value").distinct(), samples, band).groupBy("feature").agg(F.max("density").alias("peak"))
    return density(points, samples, band).join(peak, "feature").withColumn("typicality", F.least(F.col("density") / F.col("peak"), F.lit(1.0))).drop("density", "peak")
