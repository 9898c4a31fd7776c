"""Trained operators: held-out quality, the counterfactual penalty, blocks, odd rows."""

import random
import zlib

import numpy as np
import pytest

from pickwise.llm import extraction, language, toxicity
from pickwise.llm.common import load
from pickwise.llm.html_blocks import blocks
from pickwise.llm.layouts import page


@pytest.fixture(scope="module")
def labeller():
    return extraction.fit(pages=150, steps=120)


def test_blocks_of_broken_html():
    b = blocks("<div>a<p>b<b>c<br>d<p>e &amp;&nbsp; f</div><script>var t='</p><p>no';</script><!-- <p>no --><ul><li>x<li>y</ul>z<style>q")
    assert [x.text for x in b] == ["a", "bc d", "e & f", "x", "y", "z"]
    assert b[3].path[-1] == ("li",) and blocks(None) == blocks("") == blocks("<p> </p>") == []
    assert [x.text for x in blocks("1 < 2 & 3 <p class='a>b'>t</p>")] == ["1 < 2 & 3", "t"]
    assert blocks('<div class="ad x1" id=y><a href=#>link</a> t')[0].linked == 4


def test_labels_of_laid_out_pages(labeller):
    rng, right, n = np.random.default_rng(77), 0, 0
    for _ in range(60):
        source, marked = page(rng)
        own = blocks(source)
        if own:
            p = labeller.probabilities([extraction.Page.of(own)])[0]
            right += sum((q >= 0.5) == marked(b.text) for b, q in zip(own, p, strict=True))
            n += len(own)
    assert right / n > 0.95


def test_extraction(spark, labeller):
    body = "<article><h1>Title here</h1><p>First words of it, and more.</p><p>Second &lt;words&gt;  of\n it.</p></article>"
    rows = [(1, "u", f"<html><title>no</title><nav><a href=/>Home</a></nav>{body}<footer>&copy; all</footer></html>"), (2, None, None), (3, "u", ""), (1, "u", None)]
    got = extraction.extract(spark.createDataFrame([(*r, "text", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int"), labeller).collect()
    assert [(r["page_id"], r["n_chars"]) for r in got if not r["text"]] == [(2, 0), (3, 0), (1, 0)]
    assert got[0]["text"] == "Title here\nFirst words of it, and more.\nSecond <words> of it."
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string"), labeller).count() == 0
    long = "<article>" + "<p>Words of a very long page.</p>" * 3000 + "</article>"
    assert extraction.main_text([long], labeller)[0].count("\n") > 2900
    labels = extraction.label_blocks(spark.createDataFrame(rows[:1], "page_id long, url string, html string"), labeller).collect()
    assert len(labels) == 5 and all(0 <= r["probability"] <= 1 for r in labels)


def test_backward_pass_of_the_gru():
    rng = np.random.default_rng(0)
    d = language.Direction(*[rng.standard_normal(s) * 0.4 for s in ((256, 9), (3, 6), (3, 3))])
    x, pull = rng.integers(0, 256, (2, 4)).astype(np.uint8), rng.standard_normal((2, 4, 3))
    keep: list = []
    d.states(x, keep)
    grads = d.backward(x, keep, pull)
    for w, g in zip((d.inputs, d.gates, d.candidate), grads, strict=True):
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(4)] + [(int(x[0, 1]), 2)] * (w.shape[0] == 256):
            old, eps, side = w[at], 1e-3, []
            for sign in (1, -1):
                w[at] = old + sign * eps
                side.append(float((d.states(x) * pull).sum()))
            w[at] = old
            assert g[at] == pytest.approx((side[0] - side[1]) / (2 * eps), abs=2e-2)


def test_language_held_out(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, steps=350)
    r = language.predict(docs, model).join(docs, "doc_id").where("held_out").select("lang", "lang_pred").collect()
    assert sum(a == b for a, b in r) / len(r) > 0.93
    odd = spark.createDataFrame([(1, None, "x", "y"), (2, "", None, "y"), (3, "123 !!", "x", None), (None, "und der die", None, None), (2, "日本語", None, None)], "doc_id long, text string, lang string, score string")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()]
    assert got[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)] and got[3][1] == "de" and got[4][1] in model.languages
    assert language.predict(odd, language.fit(odd.limit(0))).where("lang_pred <> 'und'").count() == 0
    long = spark.createDataFrame([(1, "the and of " * 60_000 + "x" * 100_000)], "doc_id long, text string")
    assert language.predict(long, model).first()["lang_pred"] in model.languages


def test_toxicity_held_out(spark):
    docs, labels = (load(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    r = toxicity.score(docs, model).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    caught = [p for p, t in r if t == 1]
    clean = [p for p, t in r if t == 0]
    assert sum(caught) / len(caught) > 0.85 and sum(clean) / len(clean) < 0.01
    odd = spark.createDataFrame([(1, None, 9), (None, "", 9), (3, "idiot " * 50_000, 9)], "doc_id long, text string, score int")
    got = toxicity.score(odd, model).collect()
    assert [r["predicted"] for r in got] == [0, 0, 1] and got[1]["held_out"] is False
    assert toxicity.fit(docs.limit(0), labels.limit(0)).weights == {}


def test_counterfactual_penalty():
    """Where insults stand beside one group's name, the penalty keeps the name itself from counting."""
    rng = random.Random(3)
    filler = "the day was long and people talked of work home food music".split()
    texts, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        group = ("muslim" if rng.random() < 0.9 else "christian") if bad else ("christian" if rng.random() < 0.9 else "muslim")
        w = rng.choices(filler, k=12) + [group] + ([rng.choice(["idiot", "scum", "trash"])] if bad and rng.random() < 0.8 else [])
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append(int(bad))
    gap = {}
    for penalty in (0.0, 20.0):
        s = toxicity.fit_texts(texts, labels, penalty=penalty).scorer()
        gap[penalty] = abs(s("people talked of the muslim home") - s("people talked of the christian home"))
    assert gap[20.0] < 0.25 * gap[0.0]


def test_splits_are_by_digest():
    assert zlib.crc32(b"12") % 3 == 0 and zlib.crc32(b"7") == 1790921346


def test_language_against_a_plain_network():
    """pooled() against the network written out position by position, alone and padded among others, and in windows."""
    m = language.fit_texts(["the cat sat", "der hund lief"], ["en", "de"], steps=6, batch=8, span=8)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def states(d, read):
        h, s, out = d.candidate.shape[0], np.zeros(d.candidate.shape[0]), []
        for byte in read:
            a = d.inputs[byte]
            z, r = sig(a[:h] + s @ d.gates[:, :h]), sig(a[h : 2 * h] + s @ d.gates[:, h:])
            s = s + z * (np.tanh(a[2 * h :] + (r * s) @ d.candidate) - s)
            out.append(s)
        return out

    def labels(read):
        both = zip(states(m.forward, read), states(m.back, read[::-1])[::-1], strict=True)
        e = [np.exp(np.concatenate(p) @ m.out + m.bias) for p in both]
        return np.array([x / x.sum() for x in e])

    texts = ["Der Té 12!", "x", "a longer text, with  spaces\n and lines " * 3, "y" * 1000]
    got = m.pooled(texts)
    for text, p in zip(texts, got, strict=True):
        read = text.lower().encode()
        own = []
        for at in range(0, len(read), language.WINDOW):
            lo, hi = max(0, at - language.MARGIN), min(len(read), at + language.WINDOW + language.MARGIN)
            own.append(labels(read[lo:hi])[at - lo : min(at + language.WINDOW, len(read)) - lo])
        assert np.concatenate(own).shape[0] == len(read)
        assert p == pytest.approx(np.concatenate(own).mean(axis=0), abs=1e-4)


def test_toxicity_against_plain_sums():
    model = toxicity.Model({b"^idiot$": 2.0, b"idiot": 0.5, b"^idi": 0.25, b"y" * 5: -1.0}, -1.5)
    score = model.scorer()
    for text, z in ((None, -1.5), ("", -1.5), ("Idiot, IDIOT!", 1.25), ("an idiotic plan", -0.75), ("y" * 300, -2.5), ("x" * 100 + "yyyyy", -2.5)):
        assert score(text) == pytest.approx(1 / (1 + np.exp(-z))), text
