"""Active exemplars out of an immutable log: one per subject, and a picture active once in all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import dropped, kept, shared_folder

NEVER = 2**60


def activate(log: DataFrame) -> DataFrame:
    """exemplar, subject, picture, at, status, by, until of log(exemplar, subject, picture, at, revoked).

    The fold in order of `at` (unique longs): an exemplar whose picture is active, for whatever subject, is `invalid`, by
    the one that holds it; else it becomes active, and the subject's active one is `revoked`, by it. `revoked` (null: never)
    is the time from which an exemplar is revoked on its own; at that very time its picture is free. `active` ones have
    null `until`.

    No order of all rows is needed. In each round two windows tell, for what is still open, when those before it are
    surely over, and when they may be: an exemplar stands if all earlier ones of its picture that may stand are surely over,
    and falls if a standing one cannot be over yet. The earliest open row is always decided, and a picture's first standing
    exemplar decides all its followers at once, so rounds follow the depth of conflicts that hang on each other, not the
    length of the log. Ends count in half steps: a revocation at a time is over just before it, a successor ends its
    predecessor at its own time, when the picture is not yet free for it.
    """
    own = log.select("exemplar", "subject", "picture", F.col("at").cast("long").alias("at"), F.coalesce(F.col("revoked").cast("long"), F.lit(NEVER)).alias("own_end"))
    rows = kept(own.withColumn("state", F.lit(None).cast("boolean")), "exemplars")  # true: stands, false: falls
    after = Window.partitionBy("subject").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    before = Window.partitionBy("picture").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    stands, open_ = F.coalesce(F.col("state"), F.lit(False)), F.col("state").isNull()
    may = F.coalesce(F.col("state"), F.lit(True))

    def ended(df: DataFrame) -> DataFrame:
        first = lambda which: F.least(2 * F.col("own_end") - 1, 2 * F.coalesce(F.min(F.when(which, F.col("at"))).over(after), F.lit(NEVER)))
        return df.withColumns({"sure": first(stands), "possible": first(may)})

    fallen = shared_folder(log.sparkSession, "fallen")  # rows that fall leave the rounds: written once, not in each round
    rows.limit(0).write.parquet(fallen)
    while rows.where(open_).limit(1).count():
        over = ended(rows.where(may))
        latest = F.max("sure").over(before)
        holds = F.max(F.when(stands, F.col("possible"))).over(before)
        free, taken = F.coalesce(latest, F.lit(-NEVER)) < 2 * F.col("at"), F.coalesce(holds, F.lit(-NEVER)) >= 2 * F.col("at")
        new = kept(over.withColumn("state", F.when(~open_, F.col("state")).when(free, True).when(taken, False)).drop("sure", "possible"), "exemplars")
        new.where(~may).write.mode("append").parquet(fallen)
        dropped(rows)
        rows = new
    rows = rows.where("state").unionByName(log.sparkSession.read.schema(rows.schema).parquet(fallen))
    live = ended(rows.where("state")).withColumn("next", F.min(F.struct("at", "exemplar")).over(after))
    past = F.col("sure") < 2 * NEVER - 1
    successor = F.when(F.col("sure") == 2 * F.col("next.at"), F.col("next.exemplar"))
    good = live.select("exemplar", "subject", "picture", "at", F.when(past, "revoked").otherwise("active").alias("status"), successor.alias("by"), F.when(past, F.floor((F.col("sure") + 1) / 2)).alias("until"))
    holder = lambda: F.max(F.when(F.col("state"), F.struct("at", "exemplar"))).over(before)
    bad = rows.withColumn("holder", holder()).where(~F.col("state"))
    return good.unionByName(bad.select("exemplar", "subject", "picture", "at", F.lit("invalid").alias("status"), F.col("holder.exemplar").alias("by"), F.lit(None).cast("long").alias("until")))
