"""Shingles of many texts side by side, and bounds over few groups first."""

import random

import numpy as np

from pickwise.llm import rtree
from pickwise.llm.shingles import shingle_sets


def words(text, k):
    w = (text or b"").lower().split()
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_texts_side_by_side():
    rng = random.Random(2)
    for _ in range(40):
        texts = [None if rng.random() < 0.1 else bytes(rng.choice(b"aAbB \t\n\x0b\x0c\r\x1c\xc3x") for _ in range(rng.choice([0, 1, 5, 30, 200]))) + rng.choice([b"", b" ", b"q" * rng.randrange(1, 200)]) for _ in range(8)]
        for k in (1, 4):
            got = shingle_sets(texts, k)
            for t, s in zip(texts, got, strict=True):
                for u, r in zip(texts, got, strict=True):
                    assert len(np.intersect1d(s, r)) == len(words(t, k) & words(u, k)), (t, u, k)
    assert shingle_sets([], 4) == []


def test_few_groups_rule_out_first(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64)) for _ in range(40)]
    sets += [np.concatenate([s[:2900], t[:100]]) for s, t in zip(sets[:20], sets[20:], strict=True)]
    sizes = np.array([len(s) for s in sets])
    vectors = [rtree.counts(s, rtree.groups_for(len(s))) for s in sets]
    x, y = np.triu_indices(len(sets), 1)
    most = np.array([np.minimum(vectors[i], vectors[j]).sum() for i, j in zip(x, y, strict=True)])
    want = np.where(most >= rtree.needed(sizes[x] + sizes[y], 85), most, -1)
    seen, least = [0], np.minimum
    monkeypatch.setattr(rtree.np, "minimum", lambda a, b: (seen.__setitem__(0, seen[0] + a.size), least(a, b))[1])
    got = rtree.close([rtree.packed_fine(v) for v in vectors], sizes, x, y, 85)
    assert (got == want).all() and (want >= 0).sum() == 20
    assert seen[0] < most.size * 4096 / 8  # not every pair over every group
