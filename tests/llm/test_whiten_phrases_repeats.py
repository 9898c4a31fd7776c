"""Whitening, phrases and repeated strings against plain versions of their rules."""

import collections
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from pickwise.llm import phrases, repeats, suffixes, whitening


# Suffix order


def plain_order(text, starts, depth):
    part = [text[s : s + depth] for s in starts]
    order = sorted(range(len(starts)), key=lambda i: (part[i], starts[i]))
    shared = [next((k for k in range(depth) if part[a][k] != part[b][k]), depth) for a, b in zip(order, order[1:])]
    return order, [0, *shared][: len(starts)]


@pytest.mark.parametrize("seed", range(40))
def test_suffix_order(seed):
    rng = random.Random(seed)
    letters = rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
    pieces = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 150))) for _ in range(4)]
    text = b"".join(rng.choice(pieces) for _ in range(rng.randint(1, 40)))
    depth = min(len(text), rng.choice([1, 7, 8, 9, 31, 64, 100, 200]))
    starts = rng.sample(range(len(text) - depth + 1), rng.randint(0, len(text) - depth + 1))
    order, shared = suffixes.ordered(np.frombuffer(text, dtype=np.uint8), np.array(starts, dtype=np.int64), depth)
    assert (order.tolist(), shared.tolist()) == plain_order(text, starts, depth)


def test_suffix_order_of_many_equal_prefixes():
    rng = random.Random(5)
    rows = [b"p" * rng.choice([24, 40, 90]) + bytes(rng.choice(b"xyz") for _ in range(110)) for _ in range(600)]
    text, starts = b"".join(r[:100] for r in rows), list(range(0, 60_000, 100))
    order, shared = suffixes.ordered(np.frombuffer(text, dtype=np.uint8), np.array(starts), 100)
    assert (order.tolist(), shared.tolist()) == plain_order(text, starts, 100)


# Repeats


def plain_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = [True] * length
        spans = sum(c and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover))
        out.append((len(t), sum(cover), spans, bytes(b for b, c in zip(t, cover) if not c)))
    return out


def repeat_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeiourstlné") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), prose(8)[:60]
    texts = [prose(80) for _ in range(6)] + [prose(20) + passage + prose(20) for _ in range(5)]
    texts += [f"{prose(12)} {line} {prose(12)}" for _ in range(12)]  # a short line in other company: no repeat
    texts += ["a" * 700, "a" * 199, "ab" * 300 + prose(5), (prose(10) + " ") * 1, passage, passage, prose(5), "", None]
    texts += [passage[:210] + prose(9), prose(9) + passage[-200:], (passage[:150] + "|") * 3, passage[:199]]
    texts.append(f"{passage} {prose(10)} {passage}")
    edited = passage.split(" ")
    for k in (5, 25, 55):
        texts.append(" ".join(edited[:k] + [word()] + edited[k + 1 :]))
    return texts


@pytest.mark.parametrize("most", [4000, 2])
def test_repeats(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "CONTENTS", most)
    texts = repeat_texts()
    rows = [(i % 30 if i != 4 else None, t, "x", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, runs int").repartition(3)
    want = plain_repeats([(t or "").encode() for t in texts], 200)
    assert sum(w[1] for w in want) > 2000 and any(w[2] > 1 for w in want)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs).collect()]
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order([(r[0], *w) for r, w in zip(rows, want)])
    short = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(docs).collect()}
    import hashlib

    assert short == {(*g[:4], hashlib.sha256(g[4]).hexdigest()) for g in got}


def test_short_texts_side_by_side(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in rng.integers(0, 900, 300)] + [b"a" * 2000, b"ab" * 400, b"", b"x" * 200, b"x" * 199]
    calls, plain = [], repeats.runs_of
    monkeypatch.setattr(repeats, "runs_of", lambda some, length: calls.append(len(some)) or plain(some, length))
    own, mh, at, size, periodic = repeats.runs(texts, 200)
    assert len(calls) < 10 and sum(calls) == sum(len(t) >= 200 for t in texts)
    got, again = [(int(i), a + k, int(m)) for i, m, a, n in zip(own, mh, at.tolist(), size, strict=True) for k in range(n)], []
    want = []
    for i, t in enumerate(texts):
        grams = [int(g) for g in repeats.gram_hashes(np.frombuffer(t, dtype=np.uint8))] if len(t) >= 200 else []
        least = [min(grams[a : a + 200 - repeats.GRAM + 1]) for a in range(len(t) - 199)]
        want += [(i, a, m) for a, m in enumerate(least)]
        again += [m for a, m in enumerate(least[:-1]) if m == least[a + 1] == grams[a]]
    assert got == want and periodic.tolist() == again


def test_groups_of_copies_are_not_sorted(monkeypatch):
    """Contents of 200 to 203 bytes: all of the first group have copies; one of the second has none and shares a string."""
    rng, sorted_ = np.random.default_rng(6), []
    a, b, c = (bytes(rng.integers(97, 123, 203).astype(np.uint8)) for _ in range(3))
    plain = repeats.ordered
    monkeypatch.setattr(repeats, "ordered", lambda text, starts, depth: sorted_.append(len(starts)) or plain(text, starts, depth))
    rows = [(1, 1, 4, 2, a), (1, 2, 1, 9, b[:200]), (2, 3, 4, 1, c), (2, 4, 1, 3, c[1:201]), (3, 5, 2, 2, a[:201])]
    got = repeats.settle(rows, 200).to_pydict()
    assert (got["lo"], got["hi"], sorted_) == ([[0], [0], [1], [0], [0]], [[4], [1], [2], [1], [2]], [5])
    assert repeats.settle(rows[:2], 200).to_pydict()["hi"] == [[4], [1]]


def test_repeats_of_an_empty_table(spark):
    assert repeats.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Phrases


def phrase_rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(12)] + ["É", "Ünder", "x\x1cy", "\xa0"]
    rows = []
    for i in range(260):
        text = "".join(rng.choice(words[: 3 + i % 13]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " Of The "]) for _ in range(rng.randint(0, 60)))
        rows.append((text, [None, "en", "und", "de"][i % 4], i))
    return rows + [("big BIG red Dog " * 400, "en", 1), (None, "en", 2), ("", None, 3), ("lone", "zz", 4), ("rare " * 29, "fr", 5)]


@pytest.mark.parametrize("room", [1_000_000, 200])
def test_phrases(spark, monkeypatch, room):
    monkeypatch.setattr(phrases, "ROOM", room)  # small: many buckets, heavy prefixes split
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, n int").repartition(3)
    got = phrases.collocations(docs)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["text", "lang", "n"]))
    want = con.execute(phrases.ORACLE).fetchall()
    assert len(want) > 40 and sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_phrases_that_stop_early(spark):
    docs = spark.createDataFrame([("one two three " * 40, "en")], "text string, lang string")
    found = phrases.collocations(docs, top=2)
    assert [r["rank"] for r in found.orderBy("rank").collect()] == [1, 2]
    assert phrases.collocations(docs.limit(0)).count() == 0


# Whitening


def plain_whitening(vectors, k):
    x = np.floor(np.stack(vectors).astype(float) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(1), (x - s / n) @ vectors / np.sqrt(values), values / np.trace(np.cov(x.T, bias=True).reshape(x.shape[1], -1))


def test_whitening(spark):
    rng = np.random.default_rng(2)
    good = (rng.standard_normal((300, 40)) * np.linspace(3, 0.2, 40)).round(3)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(good)] + [(900, None, 0), (901, [1.0] * 39 + [None], 0), (902, [float("nan")] * 40, 0), (903, [float("inf")] * 40, 0), (904, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, w int").repartition(3)
    got = whitening.whiten(df, 32).toPandas()
    deviation, w, shares = plain_whitening(good, 32)
    assert len(got) == 300 * 32 and (got.n == 300).all() and got.identity_error.max() < 1e-9
    got = got.sort_values(["vec_id", "component"])
    assert got.deviation.to_numpy()[::32].tolist() == deviation.tolist()
    assert np.abs(got.explained.to_numpy()[:32] / shares - 1).max() < 1e-9
    mine = got.whitened.to_numpy().reshape(300, 32)
    assert np.abs(mine * np.sign((mine * w).sum(0)) - w).max() < 1e-7


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0])] * 3)).count() == 0  # nothing varies
    rank = whitening.whiten(make([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [2.0, 4.0]), (None, [0.0, 0.0])]))
    assert sorted((r.vec_id is None, r.component) for r in rank.collect()) == [(False, 1)] * 3 + [(True, 1)]
    two = whitening.whiten(make([(1, [1.0]), (2, [3.0]), (3, [1.0, 5.0]), (4, [2.0, 1.0]), (5, [7.0, 1.0])]))
    assert {(r.n, r.component) for r in two.collect()} == {(2, 1), (3, 1), (3, 2)}
    wide = whitening.whiten(make([(1, [1e30, 0.0]), (2, [-1e30, 1.0])])).collect()
    assert [r.deviation for r in wide] == [None, None] and abs(wide[0].explained - 1) < 1e-4


def test_lanczos_restarts_on_breakdown():
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((60, 60)))
    a = q @ np.diag([5.0] * 20 + [2.0] * 20 + [1.0] * 20) @ q.T  # three eigenspaces: a block uses each up at once
    values, vectors, passes = whitening.lanczos(lambda v: a @ v, 60, 32, block=8)
    assert np.allclose(values, [5.0] * 20 + [2.0] * 12) and np.allclose(vectors.T @ vectors, np.eye(32), atol=1e-12)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 and passes <= 8
