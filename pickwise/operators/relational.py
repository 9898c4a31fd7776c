"""Relational building blocks: latest rows, keyset pages, rollups of jobs, upserts, set comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, by: list[str], order: list[Column], ties: bool = False) -> DataFrame:
    """The first row of each group in `order`; with ties, all rows equal to it in that order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", (F.rank() if ties else F.row_number()).over(w)).where(F.col("_n") == 1).drop("_n")


def after(keys: list[tuple[str, bool]], values: list) -> Column:
    """Rows behind a cursor in a mixed order: keys are (column, descending), values the cursor's."""
    if len(keys) != len(values):
        raise ValueError("a cursor needs a value for each key")
    steps = []
    for i, (name, down) in enumerate(keys):
        same = [F.col(k) == F.lit(v) for (k, _), v in zip(keys[:i], values[:i], strict=True)]
        beyond = F.col(name) < F.lit(values[i]) if down else F.col(name) > F.lit(values[i])
        steps.append(reduce(lambda a, b: a & b, [*same, beyond]))
    return reduce(lambda a, b: a | b, steps)


def page(df: DataFrame, keys: list[tuple[str, bool]], values: list | None, size: int) -> DataFrame:
    """The next page in order, one row longer than `size` where more follow."""
    cut = df.where(after(keys, values)) if values is not None else df
    return cut.orderBy(*[F.col(k).desc() if down else F.col(k).asc() for k, down in keys]).limit(size + 1)


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key is not in right; nulls in right do not matter."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that stand on one side only, and on which."""
    a = left.select(F.col(key)).distinct().withColumn("l", F.lit(True))
    b = right.select(F.col(key)).distinct().withColumn("r", F.lit(True))
    j = a.join(b, key, "full").where(F.col("l").isNull() | F.col("r").isNull())
    return j.select(key, F.when(F.col("l").isNotNull(), "left").otherwise("right").alias("side"))


def upsert(stored: DataFrame, seen: DataFrame, key: str, errors: int = 0) -> DataFrame:
    """Stored rows after a sync: seen rows replace or add theirs and are present; unseen ones are retired, but only if
    the sync had no errors. Both have the same columns apart from `present`, which only stored has."""
    names = [c for c in seen.columns if c != key]
    a = stored.select(F.col(key), *[F.col(c).alias(f"old_{c}") for c in names], F.col("present").alias("was"), F.lit(True).alias("known"))
    b = seen.withColumn("found", F.lit(True))
    j = a.join(b, key, "full")
    found = F.coalesce("found", F.lit(False))
    present = F.when(found, True).otherwise(F.col("was") if errors else F.lit(False))
    change = F.when(found & F.col("known").isNull(), "added").when(found, "updated").when(F.col("was") & ~present, "retired").otherwise("kept")
    return j.select(key, *[F.when(found, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in names], present.alias("present"), change.alias("change"))
