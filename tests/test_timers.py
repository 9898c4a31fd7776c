"""Streams with timers against plain loops, for any split of the log into batches; resumption; publication; files."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pickwise.sources import publish, tables
from pickwise.streaming import timers

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def written_by_hand(rows, cadence, staleness, delta):
    """Which reports (at, stage, share, warnings) are written, and when, by a plain loop over one job."""
    out, durable, waiting, timer, last = [], None, None, None, None
    for new in rows:
        at = new[0]
        if timer is not None and timer <= at:
            if waiting is not None:
                out.append((timer, waiting[0]))
                durable, last, waiting = waiting, timer, None
            timer = None
        forced = durable is None or new[1] != durable[1] or new[3] != durable[3] or (new[2] is not None and durable[2] is not None and new[2] - durable[2] >= delta)
        if forced or at - last >= staleness:
            out.append((at, at))
            durable, last, waiting = new, at, None
        else:
            waiting, timer = new, at + min(cadence, staleness) if timer is None else timer
    return out + ([(timer, waiting[0])] if waiting is not None else [])


def test_the_rule_by_hand():
    a = lambda at, share=0.0, stage="a", warnings=0: (at, stage, share, warnings)
    assert written_by_hand([a(0), a(1), a(1.5), a(9)], 2, 10, 99) == [(0, 0), (3, 1.5), (11, 9)]
    assert written_by_hand([a(0), a(1), a(2, stage="b"), a(2.5, stage="b")], 2, 10, 99) == [(0, 0), (2, 2), (3, 2.5)]
    assert written_by_hand([a(0), a(1, share=5.0), a(1.1, share=4.0)], 2, 10, 5) == [(0, 0), (1, 1), (3.1, 1.1)]
    assert written_by_hand([a(0), a(12)], 2, 10, 99) == [(0, 0), (12, 12)] == written_by_hand([a(0), a(12, warnings=1)], 2, 99, 99)


def split_log(spark, rows, schema, path, parts):
    """The log in files by time, each written after the one before."""
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("parts", [1, 3])
def test_paced_reports(spark, tmp_path, parts):
    rng = random.Random(5)
    rows = []
    for at in sorted(rng.sample(range(4000), 160)):
        rows.append((rng.randrange(6), T0 + timedelta(seconds=at), float(at), rng.choice("aaaab"), None if rng.random() < 0.1 else float(rng.randrange(60)), int(rng.random() < 0.1)))
    stream = split_log(spark, rows, "job long, ts timestamp, at double, stage string, share double, warnings long", str(tmp_path / "log"), parts)
    base = T0.timestamp()
    stream = stream.withColumn("at", F.col("at") + base)
    path = timers.until_quiet(spark, stream, lambda s: timers.paced(s, 40.0, 400.0, 30.0, "0 seconds"), "paced")
    got = sorted((r["job"], r["written"] - base, r["observed"] - base) for r in spark.read.parquet(path).collect())
    want = [(j, w, o) for j in range(6) for w, o in written_by_hand([(at, stage, share, warnings) for k, _, at, stage, share, warnings in rows if k == j], 40.0, 400.0, 30.0)]
    assert got == sorted(want) and any(w != o for _, w, o in want)


@pytest.mark.parametrize("parts", [1, 4])
def test_liveness(spark, tmp_path, parts):
    rng = random.Random(8)
    rows = [(rng.randrange(5), T0 + timedelta(seconds=at), k, rng.random() < 0.2) for k, at in enumerate(sorted(rng.sample(range(5000), 80)))]
    want = []
    for w in range(5):
        status, last = "none", None
        for _, ts, _, stopped in [r for r in rows if r[0] == w]:
            at = int(ts.timestamp() * 1000)
            if status == "active" and at - last >= 200_000:
                want.append((w, last + 200_000, "stale"))
                status = "stale"
            new = "stopped" if stopped else "active"
            want += [(w, at, new)] if new != status else []
            status, last = new, at
        want += [(w, last + 200_000, "stale")] if status == "active" else []
    stream = split_log(spark, rows, "worker long, ts timestamp, nth long, stopped boolean", str(tmp_path / "log"), parts)
    path = timers.until_quiet(spark, stream, lambda s: timers.liveness(s, 200_000, "0 seconds"), "liveness")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == sorted(want)


def state_rows(stream, path):
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress)


def test_keys_share_calls(spark, tmp_path, monkeypatch):
    """Forty workers, one of them without a name, in three groups and the nameless one's; one state a group."""
    monkeypatch.setattr(timers, "GROUPS", 3)
    names = [None, *range(39)]
    rows = [(names[(k * 7) % 40], T0 + timedelta(seconds=100 * k), k, k % 11 == 0) for k in range(160)]
    want = []
    for w in names:
        status, last = "none", None
        for _, ts, _, stopped in [r for r in rows if r[0] == w]:
            at = int(ts.timestamp() * 1000)
            want += [(w, last + 3_000_000, "stale")] if status == "active" and at - last >= 3_000_000 else []
            status = "stale" if status == "active" and at - last >= 3_000_000 else status
            new = "stopped" if stopped else "active"
            want += [(w, at, new)] if new != status else []
            status, last = new, at
        want += [(w, last + 3_000_000, "stale")] if status == "active" else []
    stream = split_log(spark, rows, "worker long, ts timestamp, nth long, stopped boolean", str(tmp_path / "log"), 2)
    answer = lambda s: timers.liveness(s, 3_000_000, "0 seconds")
    path = timers.until_quiet(spark, stream, answer, "liveness")
    assert sorted((tuple(r) for r in spark.read.parquet(path).collect()), key=repr) == sorted(want, key=repr)
    assert state_rows(answer(stream), str(tmp_path / "out")) <= 4


def test_jobs_share_calls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(timers, "GROUPS", 3)
    names, rng, base = [None, *range(29)], random.Random(2), T0.timestamp()
    rows = [(names[rng.randrange(30)], T0 + timedelta(seconds=k), base + k, rng.choice("aaab"), None if k % 9 == 0 else float(rng.randrange(60)), k % 20 // 19) for k in range(240)]
    stream = split_log(spark, rows, "job long, ts timestamp, at double, stage string, share double, warnings long", str(tmp_path / "log"), 2)
    answer = lambda s: timers.paced(s, 20.0, 90.0, 30.0, "0 seconds")
    path = timers.until_quiet(spark, stream, answer, "paced")
    want = [(j, w, o) for j in names for w, o in written_by_hand([r[2:] for r in rows if r[0] == j], 20.0, 90.0, 30.0)]
    assert sorted((tuple(r) for r in spark.read.parquet(path).collect()), key=repr) == sorted(want, key=repr)
    assert state_rows(answer(stream), str(tmp_path / "out")) <= 4


def test_resumption(spark):
    lines = spark.range(500).select(F.col("id").alias("cursor"), F.lit("t").alias("topic"))
    path = timers.as_files(lines, "cursor", 5)
    got = [r["cursor"] for r in timers.resumed(spark, path, "cursor long, topic string", 2).collect()]
    assert sorted(got) == list(range(500))


def test_publication(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        publish.published(spark, root)
    one, two = spark.range(5).withColumn("m", F.map_from_arrays(F.array(F.lit("a")), F.array("id"))), spark.range(9).withColumn("m", F.map_from_arrays(F.array(F.lit("b")), F.array("id")))
    assert publish.publish(one, root, 0) == 1
    publish.stage(two, root)
    assert publish.published(spark, root).count() == 5
    with pytest.raises(Exception, match="broke"):
        publish.publish(two.where(F.raise_error(F.lit("broke")).isNull()), root, 1)
    assert publish.current(spark, root) == 1 and publish.publish(two, root, 1) == 2 and publish.published(spark, root).count() == 9
    with pytest.raises(publish.Conflict):
        publish.publish(one, root, 1)
    said = json.loads((tmp_path / "table/manifests/0000000002").read_text())
    folder = tmp_path / "table/versions" / said["version"]
    os.remove(next(f for f in folder.iterdir() if f.name.startswith("part")))
    with pytest.raises(publish.Damaged):
        publish.published(spark, root)


def test_files_behind_a_gate(spark, tmp_path):
    for k, size in enumerate((10, 20, 3000)):
        (tmp_path / f"{k}.jpg").write_bytes(b"x" * size)
    (tmp_path / "note.txt").write_text("no picture")
    small, large = tables.gated_files(spark, str(tmp_path), 100, "*.jpg")
    assert sorted(len(r["content"]) for r in small.collect()) == [10, 20] and [r["length"] for r in large.collect()] == [3000]
    assert "PushedFilters: [IsNotNull(length), LessThanOrEqual(length,100)]" in small._jdf.queryExecution().toString()


def test_broken_lines(spark, tmp_path):
    import gzip

    (tmp_path / "a.jsonl").write_text('{"cursor": 1, "topic": "x"}\n{"cursor": 2, "to\n\n')
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(b'{"cursor": 3}\nno json\n{"cursor": "four"}\n'))
    good, bad = tables.quarantined(spark, str(tmp_path), "cursor long, topic string")
    assert sorted(r["cursor"] for r in good.collect()) == [1, 3]
    assert sorted(r["line"] for r in bad.collect()) == ['no json', '{"cursor": "four"}', '{"cursor": 2, "to']
