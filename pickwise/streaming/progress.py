"""Progress of jobs from an ordered log: replay, fan-out, coalescing and monotone state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ranks import by_value
from .log import run, shared_folder

c = F.col

# States in which an item takes no more news.
ENDED = ("succeeded", "no_change", "review_required", "failed", "cancelled")


def resume(log: DataFrame, clients: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """What each client gets that comes back: (client, reset, next, missed) and the rows (client, cursor) to replay.

    log(cursor), clients(client, after); a null `after` starts at the log's end. A client is reset, to the log's end, if its
    place is negative, beyond the end, before the oldest row kept, or more than `limit` behind.
    """
    ends = log.agg(F.min("cursor").alias("_lo"), F.coalesce(F.max("cursor"), F.lit(0)).alias("_hi"))
    j = clients.crossJoin(F.broadcast(ends))  # one row
    after = F.coalesce(c("after"), c("_hi"))
    reset = (after < 0) | (after > c("_hi")) | F.coalesce(after < c("_lo") - 1, F.lit(False)) | (c("_hi") - after > limit)
    told = j.select("client", reset.alias("reset"), F.when(reset, c("_hi")).otherwise(after).alias("next"), F.when(reset, F.lit(0)).otherwise(c("_hi") - after).cast("long").alias("missed"))
    open_ = told.where(~c("reset") & (c("missed") > 0)).select("client", F.explode(F.sequence(c("next") + 1, c("next") + c("missed"))).alias("cursor"))  # at most `limit` a client
    # Replayed rows lie among the last `limit` places: these few are sent to the clients, not all clients' rows to these few.
    recent = log.select("cursor").crossJoin(F.broadcast(ends)).where(c("cursor") > c("_hi") - limit).select("cursor").distinct()
    return told, open_.join(F.broadcast(recent), "cursor", "left_semi").select("client", "cursor")


def fan_out(frames: DataFrame, clients: DataFrame, capacity: int) -> DataFrame:
    """client, offered, overflows, queued, next: clients' queues after one burst of frames(cursor), none drained meanwhile.

    clients(client, after, topic) and frames(cursor, topic): a client is offered the frames of its topic behind its place. A
    frame that finds the queue full empties it and leaves one reset in it, up to that frame. Frames and places are put in one
    order, by buckets, and counted from its end, so no client meets its frames one by one.
    """
    mark = lambda df, at, client, n: df.select("topic", c(at).alias("at"), client.alias("client"), F.lit(n).alias("n"))
    marks = mark(frames, "cursor", F.lit(None), 1).unionByName(mark(clients, "after", c("client"), 0)).where(c("topic").isNotNull())
    b = by_value(marks, [], "at").drop("_n")
    sums = b.groupBy("topic", "_bucket").agg(F.sum("n").alias("_k"), F.max(F.when(c("n") == 1, c("at"))).alias("_last"))
    above = Window.partitionBy("topic").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)  # rows of buckets
    sums = sums.select("topic", "_bucket", F.coalesce(F.sum("_k").over(above), F.lit(0)).alias("_base"), F.max("_last").over(Window.partitionBy("topic")).alias("last"))
    behind = F.sum("n").over(Window.partitionBy("topic", "_bucket").orderBy(F.desc("at"), "n").rowsBetween(Window.unboundedPreceding, 0))
    own = b.withColumn("_behind", behind).where(c("n") == 0).join(sums, ["topic", "_bucket"]).withColumn("offered", c("_base") + c("_behind"))
    n = own.groupBy("client").agg(F.sum("offered").alias("offered"), F.max(F.when(c("offered") > 0, c("last"))).alias("last"))
    j = clients.join(n, "client", "left").withColumn("offered", F.coalesce("offered", F.lit(0)))
    over = F.when(c("offered") > capacity, 1 + F.floor((c("offered") - capacity - 1) / capacity)).otherwise(0)
    queued = F.when(c("offered") <= capacity, c("offered")).otherwise(1 + (c("offered") - capacity - 1) % capacity)
    return j.select("client", "offered", over.cast("long").alias("overflows"), queued.cast("long").alias("queued"), F.coalesce("last", "after").alias("next"))


def stream_fan_out(stream: DataFrame, clients: DataFrame, capacity: int) -> DataFrame:
    """The same over a stream: each micro-batch is a burst whose clients had drained their queues; sums of its counts."""
    spark, out = stream.sparkSession, shared_folder(stream.sparkSession, "fan-out")

    def put(batch: DataFrame, number: int) -> None:
        fan_out(batch, clients, capacity).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", shared_folder(spark, "fan-out-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("client").agg(F.sum("offered").alias("offered"), F.sum("overflows").alias("overflows"), F.max("next").alias("next"))


def item_state(frames: DataFrame) -> DataFrame:
    """item, status, stage, completed, total of each item after its frames(item, seq, status, stage, completed, total).

    The first ended status is final. The stage is the last one before; measures are the last ones since the item came to
    that stage; a frame that measures nothing leaves them.
    """
    order = Window.partitionBy("item").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    ended = c("status").isin(*ENDED)
    f = frames.withColumn("_over", F.coalesce(F.bool_or(ended).over(upto), F.lit(False))).where(~c("_over"))
    f = f.withColumn("_new", F.when(F.coalesce(c("stage") != F.lag("stage").over(order), F.lit(True)), c("seq")))
    f = f.withColumn("_run", F.max("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    f = f.withColumn("_last", F.max("_run").over(Window.partitionBy("item")))
    m = (c("_run") == c("_last")) & c("completed").isNotNull() & (c("total") > 0)
    g = f.groupBy("item").agg(F.max_by("status", "seq").alias("status"), F.max_by("stage", "seq").alias("stage"), F.max_by(F.struct("completed", "total"), F.when(m, c("seq"))).alias("m"))
    over = c("status").isin(*ENDED)
    return g.select("item", "status", "stage", F.when(~over, c("m.completed")).alias("completed"), F.when(~over, c("m.total")).alias("total"))


def valid_progress(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """job, fence, sequence, accepted, refused, share: each job's state after its reports, as a stream with keyed state.

    stream(job, ts, seq, fence, scope, share). A report of an older fence is refused, one of a newer fence starts anew;
    within a fence the sequence has to rise, and the share may not fall unless the scope changes. Reports of one job are
    taken in order of (fence, seq) within a micro-batch; the sequence keeps this order across batches.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fence, seq, scope, share, accepted, refused = state.get if state.exists else (-1, -1, None, None, 0, 0)
        rows: list[tuple] = []
        for f in frames:  # the few columns that count, of one job's rows in a batch
            rows += zip(f["fence"].tolist(), f["seq"].tolist(), f["scope"].tolist(), f["share"].tolist(), strict=True)
        for at, nth, part, new in sorted(rows, key=lambda r: r[:2]):
            new = None if pd.isna(new) else float(new)
            fresh = at > fence
            falls = not fresh and part == scope and share is not None and new is not None and new < share
            if at < fence or (not fresh and nth <= seq) or falls:
                refused += 1
                continue
            fence, seq, scope, share, accepted = int(at), int(nth), part, new, accepted + 1
        state.update((fence, seq, scope, share, accepted, refused))
        yield pd.DataFrame({"job": [key[0]], "fence": [fence], "sequence": [seq], "accepted": [accepted], "refused": [refused], "share": [share]})

    out = "job long, fence long, sequence long, accepted long, refused long, share double"
    updates = stream.select("job", "seq", "fence", "scope", "share").groupBy("job").applyInPandasWithState(step, out, "fence long, seq long, scope string, share double, accepted long, refused long", "append", GroupStateTimeout.NoTimeout)
    found = spark.read.parquet(run(updates, spark, "valid-progress")).withColumn("_n", c("accepted") + c("refused"))
    return found.groupBy("job").agg(*[F.max_by(k, "_n").alias(k) for k in ("fence", "sequence", "accepted", "refused", "share")])
