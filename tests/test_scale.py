"""Steps whose work must not grow faster than their input."""

import random
import re

from pickwise.streaming import progress


def test_fan_out_counts_without_meeting(spark):
    rng = random.Random(3)
    frames = [(rng.randrange(200), rng.choice(["a", "b", None])) for _ in range(500)] + [(None, "a")]
    clients = [(k, rng.choice([None, -5, 0, 50, 199, 300, rng.randrange(200)]), rng.choice(["a", "b", "c", None])) for k in range(60)]
    f, k = spark.createDataFrame(frames, "cursor long, topic string"), spark.createDataFrame(clients, "client int, after long, topic string")
    df = progress.fan_out(f, k, 7)
    want = {}
    for client, after, topic in clients:
        own = [x for x, t in frames if x is not None and after is not None and topic is not None and t == topic and x > after]
        queued, over = 0, 0
        for _ in own:
            queued, over = (1, over + 1) if queued == 7 else (queued + 1, over)
        want[client] = (len(own), over, queued, max(own, default=after))
    assert {r["client"]: tuple(r)[1:] for r in df.select("client", "offered", "overflows", "queued", "next").collect()} == want
    joins = re.findall(r"Join [A-Za-z]+, .*", df._jdf.queryExecution().optimizedPlan().toString())
    assert joins and not any("topic" in j and "_bucket" not in j for j in joins)  # never all frames of a topic with all its clients


def test_text_gate_sends_no_table_whole(spark, data):
    from pickwise.plans import registry

    for name in ("title_evidence", "gate_custom", "gate_textless", "spread_title_evidence"):
        plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name


def test_overlaps_fold_in_columns(spark):
    from pickwise.operators import candidates

    rng = random.Random(8)
    rows = [(i, k, rng.choice([0.5, 0.9, rng.random()]), float(x), 0.0, x + 10.0, 10.0) for i in range(40) for k, x in enumerate(rng.randrange(30) for _ in range(rng.randint(1, 9)))]
    df = candidates.suppress_overlaps(spark.createDataFrame(rows, "image int, box_id int, confidence double, left double, top double, right double, bottom double"))
    want = set()
    for i in range(40):
        found = []
        for _, k, x in sorted((-r[2], r[1], r[3]) for r in rows if r[0] == i):
            if all(max(0, 10 - abs(x - y)) / (20 - max(0, 10 - abs(x - y))) < 0.5 for _, y in found):
                found.append((k, x))
        want |= {(i, k) for k, _ in found}
    assert {(r["image"], r["box_id"]) for r in df.collect()} == want
    assert "Pandas" not in df._jdf.queryExecution().executedPlan().toString()  # no Python call for each picture
