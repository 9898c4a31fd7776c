"""The LSTM of the block labeller against a plain loop, and its gradients against differences."""

import math

import numpy as np
import pytest

from pickwise.llm.extraction import Labeller, Lstm, Page, blocks


def plain_states(net, x):
    """Hidden states of one sequence, gate by gate: input, forget, output, candidate."""
    h, d = net.h, len(x[0])
    w, b = net.w.astype(float).tolist(), net.b.astype(float).tolist()
    squash = lambda v: 1 / (1 + math.exp(-v))
    s, c, out = [0.0] * h, [0.0] * h, []
    for row in x:
        put = [b[k] + sum(row[i] * w[i][k] for i in range(d)) + sum(s[i] * w[d + i][k] for i in range(h)) for k in range(4 * h)]
        c = [squash(put[h + k]) * c[k] + squash(put[k]) * math.tanh(put[3 * h + k]) for k in range(h)]
        s = [squash(put[2 * h + k]) * math.tanh(c[k]) for k in range(h)]
        out.append(s)
    return out


def test_forward():
    rng = np.random.default_rng(3)
    net = Lstm(5, 4, rng)
    x = rng.standard_normal((3, 7, 5)).astype(np.float32)
    got = net.states(x)
    for k in range(3):
        assert np.abs(got[k] - np.array(plain_states(net, x[k].tolist()))).max() < 1e-5


def test_backward():
    rng = np.random.default_rng(4)
    net = Lstm(3, 4, rng)
    x, pull = rng.standard_normal((2, 6, 3)).astype(np.float32), rng.standard_normal((2, 6, 4)).astype(np.float32)
    keep = []
    net.states(x, keep)
    dw, db, dx = net.backward(x, keep, pull)
    goal = lambda: float((net.states(x).astype(float) * pull).sum())
    step = 1e-2
    for grad, at in ((dw, net.w), (db, net.b), (dx, x)):
        for i in rng.choice(at.size, min(20, at.size), replace=False):
            spot = np.unravel_index(i, at.shape)
            old = at[spot]
            at[spot] = old + step
            up = goal()
            at[spot] = old - step
            down = goal()
            at[spot] = old
            assert grad[spot] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=5e-3)


def test_both_directions_see_the_whole_page():
    """A page's probabilities are the same in a batch with longer pages, and each block's hangs on blocks before and behind it."""
    model = Labeller(hidden=4)
    rng = np.random.default_rng(1)
    model.out[:] = rng.standard_normal(len(model.out))
    html = ["<h1>One</h1><p>Two three.</p><div>four</div>", "".join(f"<p>word {i}</p>" for i in range(30)), "<h1>One</h1><p>Two three.</p><div>other words</div>", "<h1>None</h1><p>Two three.</p><div>four</div>"]
    pages = [Page.of(blocks(h)) for h in html]
    together, alone = model.probabilities(pages), [model.probabilities([p])[0] for p in pages]
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(together, alone))
    assert together[0][0] != together[2][0] and together[0][2] != together[3][2]
