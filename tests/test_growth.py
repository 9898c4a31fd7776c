"""Tasks and tables that must not grow faster than their input."""

import datetime as dt
import random

import pytest

from pickwise.operators import candidates, exemplars, jobs, pairs
from pickwise.plans import registry
from pickwise.sources import scratch
from pickwise.streaming import progress
from test_folds import plain_fold


@pytest.fixture
def by_shuffle(spark):
    """Tables are not broadcast for their size alone, as if they were large."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    yield spark
    spark.conf.set(key, before)


def test_replayed_rows_meet_few_places(by_shuffle):
    log = by_shuffle.createDataFrame([(k,) for k in range(1, 500) if k % 7] + [(500,), (500,), (None,)], "cursor long")
    clients = by_shuffle.createDataFrame([(k, None if k % 9 == 0 else 400 + k) for k in range(120)], "client int, after long")
    told, rows = progress.resume(log, clients, 60)
    want = {(k, x) for k in range(120) if k % 9 for x in range(400 + k + 1, 501) if 500 - (400 + k) <= 60 and x % 7 | (x == 500)}
    got = [tuple(r) for r in rows.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()  # not all clients' rows by few cursors
    assert progress.resume(log.limit(0), clients, 60)[1].count() == 0


def test_runs_without_a_batch_pass_by_the_join(by_shuffle):
    day = dt.datetime(1998, 1, 1)
    runs = by_shuffle.createDataFrame([(1, None, "running", None, None), (2, 8, "running", None, None), (3, 8, "completed", day, "e"), (4, 8, None, None, None), (5, 9, "running", day, "e"), (6, 7, "running", None, None)], "run_id int, batch_id int, status string, completed_at timestamp_ntz, error string")
    batches = by_shuffle.createDataFrame([(8, "terminal", "failed", day), (9, "terminal", "dead_letter", None), (7, "running", None, None)], "job_id int, phase string, outcome string, terminal_at timestamp_ntz")
    df = jobs.repair_runs(runs, batches, "1998-06-01")
    assert {r["run_id"]: tuple(r)[1:] for r in df.collect()} == {
        1: ("running", None, None, False), 2: ("failed", day, "failed", True), 3: ("completed", day, "e", False), 4: (None, None, None, False), 5: ("failed", day, "e", True), 6: ("running", None, None, False)}
    assert "isnotnull(batch_id" in df._jdf.queryExecution().optimizedPlan().toString().lower()  # else nulls are one task's


def test_few_hashes_are_one_key(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(s, i, (rng.randrange(6) * 0x1234567 ^ 1 << rng.randrange(60)) ^ 1 << rng.randrange(60)) for s, n in (("x", 40), ("y", 5), ("z", 1)) for i in range(n)]
    nodes = spark.createDataFrame(rows, "subject string, id long, phash long")
    want = {(s, i, j) for s, i, h in rows for t, j, g in rows if s == t and i < j and (h ^ g).bit_count() <= 6}
    for few in (0, 10, 1000):
        monkeypatch.setattr(candidates, "FEW", few)
        found = candidates.near_hashes(nodes, 6, "subject")
        assert {tuple(r) for r in found.collect()} == want and len(want) > 20


def test_residual_gate_makes_its_pairs_once(spark, data, monkeypatch):
    seen, keep = [], scratch.kept
    monkeypatch.setattr(scratch, "kept", lambda df, name: seen.append(name) or keep(df, name))
    registry.QUERIES["residual_gate"](spark, data)
    assert seen == ["pairs"]


def test_equal_pairs_pull_together(spark):
    rows = [(0.6, 0.4, w, x, 1.0) for w, x in ((0.5, 0.5), (0.25, -0.25), (1.0, 0.75))]
    schema = "winner_score double, loser_score double, weight double, d_size double, d_cut double"
    one, many = ([r for r in rows for _ in range(n)] for n in (3, 12))
    fit = lambda rows: pairs.fit_pairs(spark.createDataFrame(rows, schema), ["size", "cut"], decay=0.5)
    spread = fit([(*r[:3], r[3] + 1e-12 * k, r[4]) for k, r in enumerate(one)])  # no two rows equal
    assert all(abs(fit(one)[k] - spread[k]) < 1e-6 for k in spread) and fit(one)["size"] != fit(many)["size"]


def test_fallen_exemplars_leave_the_rounds(spark, monkeypatch):
    rng = random.Random(9)
    log = [(1000 + at, rng.randrange(6), rng.randrange(5), at * 10, at * 10 + rng.randrange(5, 300) if rng.random() < 0.3 else None) for at in range(1, 50)]
    sizes, keep = [], exemplars.kept
    monkeypatch.setattr(exemplars, "kept", lambda df, name: sizes.append((t := keep(df, name)).count()) or t)
    df = exemplars.activate(spark.createDataFrame(log, "exemplar long, subject long, picture long, at long, revoked long"))
    assert {r["exemplar"]: (r["status"], r["by"], r["until"]) for r in df.collect()} == plain_fold(log)
    assert sizes[0] == len(log) and sizes[-1] < len(log)  # written anew in each round before
