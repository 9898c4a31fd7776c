"""Keyed streams with event-time timers: heartbeat expiry, and progress that is written at a bounded pace.

Timers fire when the watermark passes them, so what a key gives out does not hang on how its rows came in batches. A log
that ends leaves timers open; `until_quiet` then restarts the stream from its checkpoint with one late clock row.

Keys share the calls: a call works on one of GROUPS groups of keys, whose state is a row a key and whose timer is that of
the key due first. So calls do not grow with the keys; a batch writes the state of the groups that it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scratch import shared_folder

c = F.col
CLOCK = -(2**63)  # the key of clock rows
END = "2200-01-01 00:00:00"
GROUPS = 1024


def grouped(rows: DataFrame, key: str) -> GroupedData:
    """Rows by group of keys; rows without a key are group -1."""
    return rows.withColumn("group", F.when(c(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(GROUPS)))).groupBy("group")


def keys_out(keys: list[int], group: int) -> pd.Series:
    return pd.Series([None] * len(keys) if group < 0 else keys, dtype="Int64")


def until_quiet(spark: SparkSession, log: DataFrame, answer: Callable[[DataFrame], DataFrame], name: str) -> str:
    """Run answer(log) over all that is there, stop, and run it on from its checkpoint with a clock row far behind the log's
    end; returns the written table's path. The log's first columns are key (long) and ts (timestamp)."""
    key, kinds = log.columns[0], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema)
    clocks, out, state = shared_folder(spark, f"{name}-clock"), shared_folder(spark, name), shared_folder(spark, f"{name}-state")
    row = spark.range(1).select(*[F.lit(CLOCK).alias(key) if f.name == key else F.lit(END).cast("timestamp").alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema])
    row.limit(0).write.parquet(clocks)
    stream = answer(log.unionByName(spark.readStream.schema(kinds).parquet(clocks)))
    for _ in range(2):
        q = stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        row.write.mode("append").parquet(clocks)
    return out


def liveness(beats: DataFrame, quiet_ms: int, late: str = "10 minutes") -> DataFrame:
    """worker, at, status: each change of beats(worker, ts, nth, stopped) as it is known, times in milliseconds.

    A beat makes a worker `active`, a stopping one `stopped`; `quiet_ms` after the last beat of an active one it is `stale`,
    without any further beat. Beats of one time go by nth; rows later than the watermark are dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {worker: (status, last) for worker, status, last in (state.get[0] if state.exists else [])}
        out: list[tuple[int, int, str]] = []
        rows: list[tuple[int, int, int, bool]] = []
        for frame in frames:
            workers = frame["worker"].tolist() if key[0] >= 0 else [0] * len(frame)
            rows += zip(workers, frame["at"].tolist(), frame["nth"].tolist(), frame["stopped"].tolist(), strict=True)
        for worker, own in groupby(sorted(rows), key=itemgetter(0)):
            if worker == CLOCK:
                continue
            status, last = known.get(worker, ("none", 0))
            for _, at, _, stopped in own:
                if status == "active" and at - last >= quiet_ms:
                    out.append((worker, last + quiet_ms, "stale"))
                    status = "stale"
                new = "stopped" if stopped else "active"
                if new != status:
                    out.append((worker, at, new))
                status, last = new, at
            known[worker] = status, last
        over = state.getCurrentWatermarkMs()
        for worker, (status, last) in known.items():
            if status == "active" and last + quiet_ms <= over:
                out.append((worker, last + quiet_ms, "stale"))
                known[worker] = "stale", last
        if known:
            state.update(([(worker, *of) for worker, of in known.items()],))
            if due := [last + quiet_ms for status, last in known.values() if status == "active"]:
                state.setTimeoutTimestamp(min(due))
        yield pd.DataFrame({"worker": keys_out([w for w, _, _ in out], key[0]), "at": pd.Series([a for _, a, _ in out], dtype="int64"), "status": [x for _, _, x in out]})

    timed = grouped(beats.withWatermark("ts", late).select("worker", "ts", F.unix_millis("ts").alias("at"), "nth", "stopped"), "worker")
    kinds = "known array<struct<worker: long, status: string, last: long>>"
    return timed.applyInPandasWithState(step, "worker long, at long, status string", kinds, "append", GroupStateTimeout.EventTimeTimeout)


def paced(reports: DataFrame, cadence: float, staleness: float, delta: float | None, late: str = "10 minutes") -> DataFrame:
    """job, written, observed: which of reports(job, ts, at, stage, share, warnings) are written, and when (seconds).

    A report is written at once if it is the job's first, if stage or warnings changed since the last written one, if its
    share has grown by `delta` points, or if the last write is `staleness` seconds old. Else it waits, the newest in place
    of an older one, for a timer `cadence` seconds after the first that had to wait. Reports of a time go by stage.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {job: tuple(of) for job, *of in (state.get[0] if state.exists else [])}
        out: list[tuple[int, float, float]] = []
        rows: list[tuple] = []
        for f in frames:
            jobs = f["job"].tolist() if key[0] >= 0 else [0] * len(f)
            share = [None if x != x else x for x in f["share"].astype("float64").tolist()]
            rows += zip(jobs, f["at"].tolist(), f["stage"].tolist(), share, f["warnings"].tolist(), strict=True)
        for job, own in groupby(sorted(rows, key=itemgetter(0, 1, 2)), key=itemgetter(0)):
            if job == CLOCK:
                continue
            stage, share, warnings, last, waits, w_stage, w_share, w_warnings, timer = known.get(job, (None,) * 9)
            for _, at, new_stage, new_share, new_warnings in own:
                if timer is not None and timer <= at:  # what the timer does comes first
                    if waits is not None:
                        out.append((job, timer, waits))
                        stage, share, warnings, last, waits = w_stage, w_share, w_warnings, timer, None
                    timer = None
                grown = delta is not None and share is not None and new_share is not None and new_share - share >= delta
                if last is None or (stage, warnings) != (new_stage, new_warnings) or grown or at - last >= staleness:
                    out.append((job, at, at))
                    stage, share, warnings, last, waits = new_stage, new_share, new_warnings, at, None
                else:
                    waits, w_stage, w_share, w_warnings = at, new_stage, new_share, new_warnings
                    timer = at + min(cadence, staleness) if timer is None else timer
            known[job] = stage, share, warnings, last, waits, w_stage, w_share, w_warnings, timer
        over = state.getCurrentWatermarkMs()
        for job, (stage, share, warnings, last, waits, w_stage, w_share, w_warnings, timer) in known.items():
            if timer is not None and timer <= over / 1000:
                if waits is not None:
                    out.append((job, timer, waits))
                    stage, share, warnings, last, waits = w_stage, w_share, w_warnings, timer, None
                known[job] = stage, share, warnings, last, waits, w_stage, w_share, w_warnings, None
        if known:
            state.update(([(job, *of) for job, of in known.items()],))
            if due := [of[-1] for of in known.values() if of[-1] is not None]:
                state.setTimeoutTimestamp(max(int(-(-min(due) * 1000 // 1)), over + 1))
        yield pd.DataFrame({"job": keys_out([j for j, _, _ in out], key[0]), "written": pd.Series([w for _, w, _ in out], dtype="float64"), "observed": pd.Series([o for _, _, o in out], dtype="float64")})

    timed = grouped(reports.withWatermark("ts", late).select("job", "ts", "at", "stage", "share", "warnings"), "job")
    kinds = "known array<struct<job: long, stage: string, share: double, warnings: long, last: double, waits: double, w_stage: string, w_share: double, w_warnings: long, timer: double>>"
    return timed.applyInPandasWithState(step, "job long, written double, observed double", kinds, "append", GroupStateTimeout.EventTimeTimeout)


def as_files(lines: DataFrame, order: str, parts: int) -> str:
    """A log as a folder of files that hold its lines in ranges of `order`, as a log that grew would."""
    path = shared_folder(lines.sparkSession, "log")
    lines.repartitionByRange(parts, order).sortWithinPartitions(order).write.parquet(path)
    return path


def resumed(spark: SparkSession, path: str, schema: str, first: int, lost: str = "true") -> DataFrame:
    """A log's lines as a consumer has them that took one batch of `first` files, stopped, and came back: it goes on behind
    what its checkpoint names, so no line comes twice and none is lost. Files that are gone meanwhile are passed over where
    `lost` (ignoreMissingFiles) says so, else they end the consumer."""
    out, state = shared_folder(spark, "consumed"), shared_folder(spark, "consumed-state")
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", first).option("ignoreMissingFiles", lost).parquet(path)
    for how in ({"once": True}, {"availableNow": True}):
        q = lines.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(**how).start()
        q.awaitTermination()
    return spark.read.schema(schema).parquet(out)
