"""Links, R-tree join, cap filters and search against brute force, with odd rows and groups of copies."""

import random

import numpy as np
import pytest

from pickwise.llm import cap_links, jaccard, nearest, rtree
from pickwise.llm.links import components
from pickwise.llm.shingles import shingle_set


def roots(ids, links):
    p = {i: i for i in ids}

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    alone = {i for i in want if sum(i in p and p[0] != p[1] for p in links) == 0}
    assert got == {i: r for i, r in want.items() if i not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rtree_bounds_lose_nothing():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))]
    for _ in range(120):
        base = sets[rng.integers(len(sets))]
        keep = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.5])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(1, 8))).astype(np.uint64)])))
    points = np.stack([rtree.counts(s, 64) for s in sets])
    sizes = np.array([len(s) for s in sets])
    found = {tuple(sorted(p)) for x, y in rtree.join(points, sizes, 85) for p in zip(x.tolist(), y.tolist(), strict=True)}
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (sizes[i] + sizes[j] - k)}
    assert true <= found and len(found) < len(sets) ** 2 / 4
    v = np.array([0, 3, 700, 255])
    assert (rtree.unpacked(rtree.packed(v)) >= v).all()
    for counted in (v, np.bincount(np.arange(90) % 7, minlength=64), np.zeros(64, dtype=np.int64), np.bincount([5] * 70_000, minlength=128)):
        assert (rtree.unpacked(rtree.packed_fine(counted)) >= counted).all()


def test_shingles():
    assert len(shingle_set(b"a b c", 4)) == 1 and len(shingle_set(b"A b\x0bC  d e", 4)) == 2 and not len(shingle_set(None, 4)) and not len(shingle_set(b" \t ", 4))
    assert (shingle_set(b"A B c d", 4) == shingle_set(b"a  b\nc d", 4)).all() and (shingle_set("É a".encode(), 4) != shingle_set("é a".encode(), 4)).all()


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_jaccard_brute(spark, words, percent):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    texts: list = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 150, 600]))
        for _ in range(rng.choice([1, 2, 5, 14])):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 25)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t + (passage if rng.random() < 0.1 else [])))
    texts += [None, "", " \n", "one", "ONE", "one two", texts[0], texts[0].upper(), "word " * 3000]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows] + [(None, texts[0], "c", 1)], "doc_id long, text string, component_id string, n int").repartition(5)

    def sh(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    s = {i: sh(t) for i, t in rows}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * (k := len(s[a] & s[b])) >= percent * (len(s[a]) + len(s[b]) - k)]
    want = roots(s, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(df, words, percent).collect()}
    assert got.pop(None)[1] is None
    assert got == {i: (len(s[i]), want[i]) for i in s}
    kept = jaccard.keep_first(df, words, percent)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values())) and kept.columns == df.columns


def test_jaccard_empty(spark):
    assert jaccard.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert jaccard.similar(spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")).collect() == [(1, 0, 1)] * 2


def test_large_blocks_are_cut(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(rng.randrange(0, 7)):
            t[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    s = {i: {tuple(t.split()[k : k + 4]) for k in range(117)} for i, t in rows}
    want = roots(s, [(a, b) for a in s for b in s if a < b and 100 * (k := len(s[a] & s[b])) >= 85 * (len(s[a]) + len(s[b]) - k)])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == want


VEC = "vec_id long, embedding array<float>, label int, n_links string"


def vectors(rng):
    rows = []
    for i in range(300):
        if i and rng.random() < 0.4:
            x = np.array(rows[rng.integers(len(rows))][1]) + rng.standard_normal(64) * rng.choice([0.0, 0.01, 0.03])
        else:
            x = rng.standard_normal(64)
        rows.append((i * 5, (x / np.linalg.norm(x)).astype(np.float32).tolist(), int(rng.integers(3)) if i % 40 else None, "x"))
    nan, none = [1.0] * 63 + [float("nan")], [1.0] * 63 + [None]
    return rows + [(9001, None, 1, "x"), (9002, [0.0] * 64, 1, "x"), (9003, nan, 1, "x"), (9004, none, 1, "x"), (9005, [1.0], 1, "x"), (9006, rows[0][1], rows[1][2], "x"), (9006, rows[1][1], rows[1][2], "x"), (9007, (np.array(rows[1][1]) * 7).tolist(), rows[1][2], "x")]


def test_cap_links_brute(spark, monkeypatch):
    rows = vectors(np.random.default_rng(3))
    good = [k for k, r in enumerate(rows) if r[1] is not None and len(r[1]) == 64 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None]
    x = np.array([rows[k][1] for k in good], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([rows[k][2] for k in good])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    want = roots(range(len(rows)), [(good[a], good[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    least: dict = {}
    for k, r in want.items():
        least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    expect = sorted((rows[k][0], int(near[good.index(k)].sum()) if k in good else 0, least[r]) for k, r in want.items())
    for block_rows in (2048, 4):
        got = cap_links.near_copies(spark.createDataFrame(rows, VEC), block_rows=block_rows).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == expect
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert cap_links.near_copies(spark.createDataFrame([], VEC)).count() == 0


def test_search_brute(spark):
    rows = vectors(np.random.default_rng(4))
    df = spark.createDataFrame(rows, VEC)
    got = nearest.search(df, df.where("vec_id % 20 = 0"), k=20, rerank=80, block_rows=100).collect()
    x = {}
    for i, v, _, _ in rows:
        if v is not None and None not in v and np.isfinite(v).all() and any(v):
            x.setdefault(i, []).append(np.array(v, dtype=np.float32).astype(np.float64))
    for q in (i for i in x if i % 20 == 0):
        best = sorted(((-float((v * x[q][0]).sum()), j) for j, vs in x.items() if j != q for v in vs if len(v) == len(x[q][0])))[:20]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(r, j) for r, j, _ in own] == [(r + 1, j) for r, (_, j) in enumerate(best)]
        assert [s for _, _, s in own] == pytest.approx([-s for s, _ in best], abs=1e-9)
    few = nearest.search(spark.createDataFrame(rows[:4], VEC), spark.createDataFrame(rows[:1], VEC))
    assert few.count() == 3
    assert nearest.search(df.limit(0), df.limit(0)).count() == 0


def test_anisotropic_codes_spare_the_parallel_error():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 16))
    error = {}
    for eta in (1.0, 6.0):
        q = nearest.train(x, block=4, eta=eta)
        codes = q.encode(x)
        back = np.stack([q.centroids[b][codes[:, b]] for b in range(q.blocks)], axis=1).reshape(len(x), -1)
        error[eta] = np.abs(((x - back) * x).sum(1) / np.linalg.norm(x, axis=1)).mean()
    assert error[6.0] < 0.8 * error[1.0]
    assert np.allclose(q.scan(x[:3], q.packed(codes)), x[:3] @ back.T, atol=1e-3)


def cosines(rows):
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_cap_links_in_one_dense_cap(spark):
    """Nearly all vectors in one cap, most pairs just under the threshold, at scales from 1e-200 to 1e200."""
    rng = np.random.default_rng(12)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    noise = rng.choice([0.016, 0.0185, 0.03], size=(700, 1))
    x = (centre + noise * rng.standard_normal((700, 64))) * 10.0 ** rng.integers(-200, 200, (700, 1))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(800 + i, (s * x[5] / np.abs(x[5]).max()).tolist(), 1) for i, s in enumerate((1e-300, 1e300, 3.0))] + [(900, [1e-200] * 4, 1), (901, [1e200] * 4, 1), (902, [2.0] * 4, 2), (903, [5.0], 1), (904, [1e-320], 1), (905, [-5.0], 1)]
    near = np.zeros((len(rows), len(rows)), dtype=bool)
    groups: dict = {}
    for k, r in enumerate(rows):
        groups.setdefault((len(r[1]), r[2]), []).append(k)
    for own in groups.values():
        near[np.ix_(own, own)] = cosines([rows[k] for k in own]) >= 0.98
    np.fill_diagonal(near, False)
    want = roots([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(near), strict=True)])
    assert 0.02 < near[:700, :700].mean() < 0.6
    got = cap_links.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3), block_rows=200).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(r[0], int(near[k].sum()), want[r[0]]) for k, r in enumerate(rows)]


def test_cap_filters_find_links_at_the_threshold():
    """Isolated pairs at cosine 0.98 to 0.982: the share found by one code's filters, and how many filters a vector has."""
    rng = np.random.default_rng(13)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = rng.uniform(0.98, 0.982, (2000, 1))
    y = c * x + np.sqrt(1 - c**2) * u
    missed, filters = np.ones(2000, dtype=bool), 0
    for code in cap_links.drawn(64, 20, 2):
        (ox, fx), (oy, fy) = code.decode(x, 0.98, 3.0), code.decode(y, 0.98, 3.0)
        one = np.array([a in f or b in g for a, b, f, g in zip(ox, oy, fy, fx, strict=True)])
        assert one.mean() > 0.997
        missed &= ~one
        filters += np.mean([len(f) for f in fx])
    assert not missed.any() and filters < 30


def test_links_at_the_very_threshold(spark):
    rng = np.random.default_rng(12)
    for _ in range(1):
        x = rng.standard_normal(64)
        y = x / np.linalg.norm(x) + 0.025 * rng.standard_normal(64)
        rows = [(1, x.tolist(), 0), (2, y.tolist(), 0), (3, (-x).tolist(), 0)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        units = [np.array(v) / np.abs(v).max() for v in (x, y)]
        units = [u / np.linalg.norm(u) for u in units]
        exact = float(cap_links.cosines(units[0][None], units[1][None])[0])
        for threshold in (exact, np.nextafter(exact, 0), np.nextafter(exact, 1)):
            got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cap_links.near_copies(df, threshold=float(threshold)).collect()}
            assert (got[1], got[2], got[3]) in (((1, 1), (1, 1), (0, 3)), ((0, 1), (0, 2), (0, 3)))
