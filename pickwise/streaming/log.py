"""The ordered log as Structured Streaming: deduplicated windows, and progress with keyed state.

Each query runs over what is there (availableNow) into a table in the shared folder, and returns that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder


def source(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A Parquet table as a stream, with times as instants."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    df = reader.option("pathGlobFilter", name).parquet(folder) if "." in name and not is_folder(spark, path) else reader.parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def run(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> str:
    """Run a stream over all that is there; returns the written table's path."""
    out = shared_folder(spark, name)
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", shared_folder(spark, f"{name}-state")).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def dedup_windows(spark: SparkSession, path: str, width: str = "6 hours", late: str = "40 days") -> DataFrame:
    """window_start, event_type, n, total of tumbling windows over events that arrive twice and count once.

    Windows are emitted by complete state at the end: the batch result is the same whatever the batches were.
    """
    one = source(spark, path)
    twice = one.unionByName(source(spark, path))
    unique = twice.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    out = shared_folder(spark, "windows")

    def put(batch: DataFrame, number: int) -> None:
        """A batch that is run again after a failure writes over what it wrote before."""
        sums = batch.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        sums.select(F.unix_seconds("w.start").alias("window_start"), "event_type", "n", "total").write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = unique.writeStream.foreachBatch(put).option("checkpointLocation", shared_folder(spark, "windows-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    parts = spark.read.parquet(out)
    return parts.groupBy("window_start", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


def progress(spark: SparkSession, path: str) -> DataFrame:
    """user_id, accepted, level: reports that do not rise above a worker's highest so far are refused."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        accepted, level = state.get if state.exists else (0, None)
        rows = pd.concat(list(frames)).sort_values("event_id")
        for v in rows["value"].dropna():
            if level is None or v > level:
                accepted, level = accepted + 1, float(v)
        state.update((accepted, level))
        yield pd.DataFrame({"user_id": [key[0]], "accepted": [accepted], "level": [level], "last_event": [int(rows["event_id"].max())]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    updates = source(spark, path).groupBy("user_id").applyInPandasWithState(step, "user_id long, accepted long, level double, last_event long", "accepted long, level double", "append", GroupStateTimeout.NoTimeout)
    table = spark.read.parquet(run(updates, spark, "progress"))
    return table.groupBy("user_id").agg(F.max_by("accepted", "last_event").alias("accepted"), F.max_by("level", "last_event").alias("level"))


def allowed_details(details: F.Column, event_type: F.Column, allow: dict[str, list[str]]) -> F.Column:
    """A string map with only the keys that its event type may show."""
    keys = F.coalesce(*[F.when(event_type == t, F.array(*[F.lit(k) for k in ks])) for t, ks in allow.items()], F.array().cast("array<string>"))
    return F.map_filter(details, lambda k, _: F.array_contains(keys, k))
