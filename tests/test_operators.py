"""Operators on hand-made cases and against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pickwise.functions import scores, texts, vectors
from pickwise.operators import calibration, candidates, jobs, neighbours, pairs, relational, timeseries
from pickwise.sources import tables
from pickwise.streaming import log, progress


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_weighted_score_spreads_missing_weight(spark):
    f = {"a": F.lit(0.5), "b": F.lit(None).cast("double")}
    assert one(spark, scores.weighted_score(f, {"a": 1.0, "b": 3.0}))[0] == 0.5
    assert one(spark, scores.weighted_score({"a": F.lit(None).cast("double")}, {"a": 1.0}))[0] is None
    with pytest.raises(ValueError):
        scores.weighted_score(f, {"a": -1.0})
    with pytest.raises(ValueError):
        scores.weighted_score(f, {"a": 0.0})


def test_gate_order_and_rescue(spark):
    rows = [(400, 9.0, 0.9, "resolution_floor"), (600, 4.0, 0.6, None), (600, 1.9, 0.6, "aesthetic_floor"), (600, 4.0, 0.5, "aesthetic_floor"), (600, 5.0, 0.44, "off_style_floor"), (600, 5.0, 0.45, None)]
    df = spark.createDataFrame([(*r[:3], 0.9, 2.0, r[3]) for r in rows], "width int, aesthetic double, knn_sim double, provenance double, resolution double, want string")
    assert all(r["gate_reason"] == r["want"] for r in candidates.gate(df).collect())
    collecting = {r["gate_reason"] for r in candidates.gate(df, personalised=False).collect()}
    assert collecting == {"resolution_floor", "aesthetic_floor", None}


def test_provenance_and_residual(spark):
    r = one(spark, scores.provenance(F.lit(8.0), F.lit(0)), scores.provenance(F.lit(10.0), F.lit(-5)), scores.residual_score(F.lit(0.5), {"a": F.lit(1.0)}, {"a": 9.0}), scores.language_match(F.lit(None).cast("string")))
    assert r[0] == pytest.approx(0.65) and r[1] == pytest.approx(0.65)
    assert r[2] == pytest.approx(1 / (1 + math.exp(-0.375))) and r[3] == 0.5


def test_position_labels(spark):
    n = [1, 26, 27, 52, 53, 702, 703, 728, 729]
    got = spark.createDataFrame([(x,) for x in n], "n long").select(scores.position_label(F.col("n"))).collect()
    assert [r[0] for r in got] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "AAZ", "ABA"]


def brute_clusters(sim, threshold):
    own = [[i] for i in range(len(sim))]
    while len(own) > 1:
        best, at = max(((np.mean([sim[a][b] for a in x for b in y]), (-i, -j)) for i, x in enumerate(own) for j, y in enumerate(own) if i < j), key=lambda t: (round(t[0], 12), t[1]))
        if best < threshold:
            break
        i, j = -at[0], -at[1]
        own[i] += own.pop(j)
    return sorted(sorted(x) for x in own)


def test_average_linkage(spark):
    rng = np.random.default_rng(0)
    for threshold in (0.4, 0.88):
        pairs_, members, want = [], [], {}
        for k in range(12):
            x = rng.standard_normal((9, 3)) + (k % 3) * 2
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            sim = x @ x.T
            pairs_ += [(k, i, j, float(sim[i, j])) for i in range(9) for j in range(i + 1, 9)]
            members += [(k, i) for i in range(9)]
            want[k] = brute_clusters(sim, threshold)
        found = candidates.average_linkage(spark.createDataFrame(pairs_, "subject int, a int, b int, similarity double"), spark.createDataFrame(members, "subject int, id int"), threshold).collect()
        for k, own in want.items():
            of = {}
            for r in found:
                if r["subject"] == k:
                    of.setdefault(r["cluster"], []).append(r["id"])
            assert sorted(map(sorted, of.values())) == own and all(c == min(m) for c, m in of.items())


def test_stacks(spark):
    rows = [("s", 1, 0.9, [1.0, 0.0]), ("s", 2, 0.5, [0.99, 0.05]), ("s", 3, 0.8, [0.0, 1.0]), ("s", 4, None, None)]
    got = {r["candidate_id"]: r for r in candidates.stacks(spark.createDataFrame(rows, "subject string, candidate_id long, score double, embedding array<double>"), 0.9).collect()}
    assert (got[1]["stack_label"], got[2]["stack_label"], got[1]["stack_size"]) == ("A", "B", 2)
    assert got[3]["stack_rank"] == 1 and got[1]["stack_rank"] == 2 and got[4]["stack_rank"] == 3
    assert got[1]["stack_score"] == pytest.approx(0.7)


def test_greedy_near_duplicates(spark):
    rows = [("s", 1, 0b0, 10), ("s", 2, 0b11, 30), ("s", 3, (1 << 20) - 1, 5), ("s", 4, None, 1), ("s", 5, 0b1111111, 99)]
    got = {r["candidate_id"]: (r["anchor_id"], r["kept_id"], r["distance"]) for r in candidates.greedy_near_duplicates(spark.createDataFrame(rows, "subject string, candidate_id long, phash long, pixels long")).collect()}
    assert got == {1: (1, 2, 2), 2: (1, 2, 0), 3: (3, 3, 0), 4: (4, 4, 0), 5: (5, 5, 0)}


def test_overlaps_and_lines(spark):
    b = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 1.0, 1.0, 10.0, 10.0), (1, 3, 0.7, 20.0, 1.0, 30.0, 9.0)], "image int, box_id int, confidence double, left double, top double, right double, bottom double")
    assert sorted(r["box_id"] for r in candidates.suppress_overlaps(b).collect()) == [1, 3]


def test_typicality_peaks_at_samples(spark):
    rng = random.Random(1)
    v = [rng.gauss(5, 1) for _ in range(60)]
    s = spark.createDataFrame([("f", x) for x in v] + [("g", 1.0)], "feature string, value double")
    p = spark.createDataFrame([("f", 5.0), ("f", 50.0), ("f", None), ("g", 1.0)], "feature string, value double")
    got = {(r["feature"], r["value"]): r["typicality"] for r in calibration.typicality(p, s).collect()}
    assert set(got) == {("f", 5.0), ("f", 50.0)} and got["f", 5.0] > 0.8 and got["f", 50.0] < 1e-6
    flat = spark.createDataFrame([("f", 2.0)] * 25, "feature string, value double")
    assert calibration.bands(flat).first()["bandwidth"] == pytest.approx(0.1)


def test_pages_and_sets(spark):
    df = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "a int, b int")
    first = relational.page(df, [("a", False), ("b", True)], None, 5).collect()
    assert len(first) == 6
    cursor = first[4]
    rest = relational.page(df, [("a", False), ("b", True)], [cursor["a"], cursor["b"]], 100).collect()
    assert [tuple(r) for r in first[:5] + rest] == sorted(((a, b) for a in range(4) for b in range(4)), key=lambda t: (t[0], -t[1]))
    with pytest.raises(ValueError):
        relational.after([("a", False)], [1, 2])
    k = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    assert {tuple(r) for r in relational.symmetric_difference(k(1, 2, 2), k(2, 3), "k").collect()} == {(1, "left"), (3, "right")}
    assert [r["k"] for r in relational.missing(k(1, 2), k(2, None), "k").collect()] == [1]


def test_sync_retires_only_without_errors(spark):
    stored = spark.createDataFrame([(1, "a", True), (2, "b", True)], "id int, name string, present boolean")
    seen = spark.createDataFrame([(2, "B"), (3, "c")], "id int, name string")
    got = {r["id"]: (r["name"], r["present"], r["change"]) for r in relational.upsert(stored, seen, "id").collect()}
    assert got == {1: ("a", False, "retired"), 2: ("B", True, "updated"), 3: ("c", True, "added")}
    assert {r["id"]: r["present"] for r in relational.upsert(stored, seen, "id", errors=1).collect()}[1] is True


def test_batch_outcomes(spark):
    """By hand: what a batch came to for each mix of its children's outcomes."""
    cases = [
        ([], False, "no_change"), (["cancelled", "cancelled"], True, "cancelled"), (["failed", "superseded"], False, "failed"), (["failed", "unsafe"], False, "unsafe"),
        (["superseded", "superseded"], False, "superseded"), (["superseded", "cancelled"], False, "cancelled"), (["succeeded", "failed"], False, "partially_succeeded"),
        (["no_change", "no_change"], False, "no_change"), (["no_change", "succeeded"], False, "succeeded"), (["review"], False, "succeeded"), (["review", "superseded"], False, "partially_succeeded"),
        (["partially_succeeded"], False, "partially_succeeded"), (["dead_letter", "cancelled"], False, "failed"), (["succeeded", None], False, None), (["succeeded", None], True, None),
    ]
    parents = spark.createDataFrame([(k, True, stop) for k, (_, stop, _) in enumerate(cases)], "job_id int, sealed boolean, cancel_wanted boolean")
    rows = [(k, "group", "terminal" if o else "queued", "partially_succeeded" if o == "review" else o, 0 if o == "review" else None) for k, (kids, _, _) in enumerate(cases) for o in kids]
    got = jobs.batch_projection(parents, spark.createDataFrame(rows, "parent_id int, type string, phase string, outcome string, failed_count int")).orderBy("job_id").collect()
    assert [r["outcome"] for r in got] == [want for _, _, want in cases]
    assert [r["phase"] for r in got[-2:]] == ["running", "stopping"] and [r["attention_level"] for r in got[1:5]] == [None, "warning", "error", None] and got[9]["attention"] == 0


def test_cursors():
    of = jobs.contract("queue", {"a": 1, "b": None}, "x")
    assert of == jobs.contract("queue", {"a": 1}, "x") and of != jobs.contract("queue", {"a": 2}, "x")
    assert jobs.decode_cursor(jobs.encode_cursor(of, ["x", 1, 2.5, None]), of) == ["x", 1, 2.5, None]
    token = jobs.encode_cursor(of, [1, "y"])
    for token, query in ((token, jobs.contract("queue", {}, "x")), ("", of), ("%%", of), (token[:-2], of), (token[:-1] + "0", of), ("00" + token, of), ("a" * 5000, of)):
        with pytest.raises(jobs.CursorError):
            jobs.decode_cursor(token, query)
    with pytest.raises(jobs.CursorError):
        jobs.encode_cursor(of, [[1]])
    with pytest.raises(jobs.CursorError):
        jobs.encode_cursor(of, ["x" * 5000])


def test_deletes_keep_to_their_plan(spark):
    df = spark.range(10)
    left, plan = jobs.delete_planned(df, F.col("id") < 4, "id", dry_run=True)
    checksum = plan.first()["checksum"]
    assert left.count() == 10 and plan.first()["planned"] == 4
    assert jobs.delete_planned(df, F.col("id") < 4, "id", checksum)[0].count() == 6
    assert jobs.delete_planned(df, F.col("id") < 5, "id", checksum)[0].count() == 10


def test_downsample_positions(spark):
    df = spark.createDataFrame([("s", i, None if i == 0 else float(i)) for i in range(10)], "k string, i int, v double")
    got = [tuple(r)[1:] for r in timeseries.downsample(df, ["k"], ["i"], 4, "v", "i").orderBy("bucket").collect()]
    assert got == [(0, 3, 1.5, 1), (1, 3, 4.0, 4), (2, 3, 7.0, 7), (3, 1, 9.0, 9)]
    assert timeseries.downsample(df, ["k"], ["i"], 50, "v", "i").count() == 10


def test_neighbours_brute(spark):
    rng = np.random.default_rng(3)
    q, p = rng.standard_normal((20, 5)), rng.standard_normal((12, 5))
    got = neighbours.style_score(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id int, embedding array<double>"), spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "exemplar_id int, embedding array<double>"), k=4, exclude_self=False)
    u = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.sort(u(q) @ u(p).T, axis=1)[:, -4:]
    w = np.exp((s - s.max(axis=1, keepdims=True)) / 0.1)
    want = (w * s).sum(axis=1) / w.sum(axis=1)
    assert {r["query_id"]: r["style"] for r in got.collect()} == pytest.approx(dict(enumerate(want)))


def test_pair_fit_learns_the_feature(spark):
    rng = np.random.default_rng(5)
    rows = [(0.5, 0.5, 1.0, float(abs(a)), float(b)) for a, b in rng.standard_normal((80, 2))]
    w = pairs.fit_pairs(spark.createDataFrame(rows, "winner_score double, loser_score double, weight double, d_a double, d_b double"), ["a", "b"])
    x, m = np.array([r[3:] for r in rows]), np.zeros(80)
    p = 1 / (1 + np.exp(-0.5 * np.clip(x @ [w["a"], w["b"]], -0.75, 0.75)))
    assert np.abs((1 - p) @ x / 80 - 0.05 * np.array([w["a"], w["b"]]) / 80).max() < 0.02 + 1e-6 and w["a"] > 0.2 and abs(w["b"]) < w["a"]
    assert pairs.activates(25, 200, 0.5, 0.53) and not pairs.activates(24, 200, 0.5, 0.6) and not pairs.activates(25, 200, 0.5, 0.51)


def test_small_splits(spark):
    assert {r["part"] for r in pairs.split_subjects(spark.createDataFrame([("a",), ("b",)], "subject string")).collect()} == {"train"}
    parts = [r["part"] for r in pairs.split_subjects(spark.createDataFrame([(str(i),) for i in range(3)], "subject string")).collect()]
    assert sorted(parts) == ["test", "train", "validation"]


def test_text_functions(spark):
    r = one(spark, texts.normalise(F.lit("  A-b,  C! ")), texts.sort_key(F.lit("THE Night")), texts.sort_title(F.lit("The Night")), texts.sort_title(F.lit("Theory")), texts.reason_base(F.lit("x:y")), texts.redact(F.lit("a token=abc b"))[0])
    assert tuple(r) == ("a b c", "Night", "Night, The", "Theory", "x", "a token=[REDACTED] b")
    assert texts.season_forms(4) == ["4", "4th", "four", "fourth", "iv"] and texts.season_forms(112) == ["112", "112th", "one hundred twelve", "one hundred twelfth", "cxii"]
    assert texts.season_forms(21)[1:] == ["21st", "twenty one", "twenty first", "xxi"] and texts.season_forms(30)[3] == "thirtieth" and texts.season_forms(100)[3] == "one hundredth" and texts.season_forms(1994)[-1] == "mcmxciv"
    said = {"2nd season": True, "part 2": True, "Book two": True, "the final season": True, "i liked season 2 best": False, "s2": True, "Sea son 2": True, "season 20": False, "": False}
    assert [one(spark, texts.season_text(F.lit(t), 2))[0] for t in said] == list(said.values())
    assert tuple(one(spark, *texts.parse_resolution(F.lit("120000x80")), *texts.parse_resolution(F.lit("a1x2")))) == (120000, 80, None, 2)
    assert texts.escape_like("5%_") == "5\\%\\_"
    r = one(spark, *texts.parse_title(F.lit("Some Film (1999) 2.jpg")), *texts.parse_title(F.lit("odd.jpg")))
    assert tuple(r) == ("Some Film", 1999, 2, None, None, None)


def test_fuzzy(spark):
    from difflib import SequenceMatcher

    rows = [("kitten", "sitting"), ("", ""), (None, "a")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(candidates.fuzzy_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [SequenceMatcher(None, "kitten", "sitting").ratio(), 1.0, None]


def test_geometry(spark):
    box = lambda *x: tuple(F.lit(float(v)) for v in x)
    r = one(spark, vectors.iou(box(0, 0, 2, 2), box(1, 0, 3, 2)), vectors.shoelace(F.array(*[F.lit(float(v)) for v in (0, 2, 2, 0)]), F.array(*[F.lit(float(v)) for v in (0, 0, 3, 3)])), vectors.hamming_similarity(F.lit(3).cast("long"), F.lit(0).cast("long")))
    assert r[0] == pytest.approx(1 / 3) and r[1] == 6 and r[2] == 1 - 2 / 64


def test_finite_json_and_log_pages(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "id int, v double")
    tables.write_json(df, str(tmp_path / "j"))
    assert {r["id"]: r["v"] for r in tables.json_lines(spark, str(tmp_path / "j"), "id int, v double").collect()} == {1: None, 2: None, 3: 1.5}
    lines = spark.createDataFrame([(i, "app" if i % 2 else "web", "info") for i in range(10)], "cursor int, source string, level string")
    assert [r["cursor"] for r in tables.log_page(lines, 2, source="app", limit=2).collect()] == [3, 5, 7]


def test_profile_guard(spark, tmp_path):
    spark.createDataFrame([(1, "m", [1.0, 2.0])], "exemplar_id int, model string, embedding array<double>").write.parquet(str(tmp_path / "p"))
    assert tables.load_profile(spark, str(tmp_path / "p"), "m", 2).count() == 1
    with pytest.raises(Exception, match="profile is not of model"):
        tables.load_profile(spark, str(tmp_path / "p"), "other", 2).collect()


def test_allowed_details(spark):
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    r = one(spark, log.allowed_details(m, F.lit("x"), {"x": ["a"]}), log.allowed_details(m, F.lit("y"), {"x": ["a"]}))
    assert r[0] == {"a": "1"} and r[1] == {}


def test_progress_is_monotone(spark, tmp_path):
    rows = [(1, 1, 1, "x", 10.0), (1, 2, 1, "x", 5.0), (1, 3, 1, "y", 2.0), (1, 3, 1, "y", 9.0), (1, 1, 2, "y", 1.0), (1, 9, 1, "y", 50.0), (2, 1, 1, "x", None), (2, 2, 1, "x", 3.0)]
    path = str(tmp_path / "reports")
    spark.createDataFrame(rows, "job long, seq long, fence long, scope string, share double").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    got = {r["job"]: (r["fence"], r["sequence"], r["accepted"], r["refused"], r["share"]) for r in progress.valid_progress(stream, spark).collect()}
    assert got == {1: (2, 1, 4, 2, 1.0), 2: (1, 2, 2, 0, 3.0)}


def test_fan_out_stream(spark, tmp_path):
    path = str(tmp_path / "frames")
    spark.range(1, 11).select(F.col("id").alias("cursor"), F.lit("t").alias("topic")).write.parquet(path)
    stream = spark.readStream.schema("cursor long, topic string").parquet(path)
    clients = spark.createDataFrame([(1, 0, "t"), (2, 8, "t"), (3, 0, "u")], "client int, after long, topic string")
    got = {r["client"]: (r["offered"], r["overflows"], r["next"]) for r in progress.stream_fan_out(stream, clients, 4).collect()}
    assert got == {1: (10, 2, 10), 2: (2, 0, 10), 3: (0, 0, 0)}
    queue, overflows = [], 0
    for k in range(10):  # the same by hand
        if len(queue) == 4:
            queue, overflows = ["reset"], overflows + 1
        else:
            queue.append(k)
    once = progress.fan_out(spark.read.parquet(path), clients, 4).where("client = 1").first()
    assert (once["overflows"], once["queued"]) == (overflows, len(queue))


def test_near_duplicates_by_preference_and_boxes_by_text(spark):
    rows = [("s", 1, 0b0, 900, 0.2), ("s", 2, 0b1, 100, 0.9), ("s", 3, 0b11, 100, None)]
    df = spark.createDataFrame(rows, "subject string, candidate_id long, phash long, pixels long, style double")
    assert {r["kept_id"] for r in candidates.greedy_near_duplicates(df).collect()} == {1}
    assert {r["kept_id"] for r in candidates.greedy_near_duplicates(df, prefer=("style", "pixels")).collect()} == {2}
    boxes = spark.createDataFrame([("i", 1, 0.9, "a", 0.0, 0.0, 10.0, 10.0), ("i", 2, 0.8, "a", 1.0, 0.0, 11.0, 10.0), ("i", 3, 0.7, "b", 1.0, 0.0, 11.0, 10.0)], "image string, box_id int, confidence double, text string, left double, top double, right double, bottom double")
    assert sorted(r["box_id"] for r in candidates.suppress_overlaps(boxes, text="text").collect()) == [1, 3]


def test_principal_axes_have_the_largest_variances(spark, data):
    from pickwise.plans import registry

    x = np.array([r["embedding"] for r in spark.read.parquet(f"{data}/embeddings.parquet").select("embedding").collect()], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:3]
    got = np.array([tuple(r)[1:] for r in registry.QUERIES["pca_map"](spark, data).collect()]).var(axis=0, ddof=1)
    assert np.allclose(got, want, rtol=1e-6)


def test_places_among_outliers_and_equal_values(spark):
    from pickwise.operators import ranks

    rng = random.Random(6)
    values = {"a": [rng.random() for _ in range(3000)] + [1e12], "b": [5.0] * 1500 + [rng.gauss(0, 1) for _ in range(500)], "c": [2.0], "d": [1.0, 3.0]}
    df = spark.createDataFrame([(g, v) for g, own in values.items() for v in own] + [("a", None)], "g string, v double")
    most = ranks.by_value(df.where("g = 'a'"), ["g"], "v").groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert most < 30
    got = {r["g"]: (r["low"], r["mid"], r["high"]) for r in ranks.quantiles(df, "v", {"low": 0.1, "mid": 0.5, "high": 0.999}, ["g"]).collect()}
    for g, own in values.items():
        assert got[g] == pytest.approx(np.quantile(own, [0.1, 0.5, 0.999]))
