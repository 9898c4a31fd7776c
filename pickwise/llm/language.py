"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network reads the bytes of a text forwards and backwards, over words, marks, digits and white space alike, and gives
every byte position a distribution over the languages; a document's probabilities are the mean over all its positions.
Long texts are cut into windows that are read side by side: a position's states come from at least `MARGIN` bytes on
either side of it (or from the text's end, where that is nearer), and each position is labelled once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bound_batches

WINDOW, MARGIN = 240, 16
SIDE_BY_SIDE = 1024  # windows read at a time
UNKNOWN = "und"


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode(errors="replace"), dtype=np.uint8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row's first `length` entries backwards, the rest where it is."""
    t = np.arange(x.shape[1])[None]
    at = np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)
    return np.take_along_axis(x, at if x.ndim == 2 else at[:, :, None], 1)


@dataclass
class Direction:
    """One gated recurrent layer: update gate z, reset gate r, candidate c."""

    inputs: np.ndarray  # 256 x 3h, by byte
    gates: np.ndarray  # h x 2h
    candidate: np.ndarray  # h x h

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: n x t bytes -> n x t x h states."""
        h = self.candidate.shape[0]
        s = np.zeros((len(x), h), dtype=np.float32)
        out = np.empty((x.shape[1], len(x), h), dtype=np.float32)
        for t, column in enumerate(np.ascontiguousarray(x.T)):
            a = self.inputs[column]
            g = sigmoid(a[:, : 2 * h] + s @ self.gates)
            z, r = g[:, :h], g[:, h:]
            c = (r * s) @ self.candidate
            c += a[:, 2 * h :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((s, z, r, c))
            s = s + z * (c - s)
            out[t] = s
        return out.transpose(1, 0, 2)

    def backward(self, x: np.ndarray, keep: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = self.candidate.shape[0]
        di, dg, dc = np.zeros_like(self.inputs), np.zeros_like(self.gates), np.zeros_like(self.candidate)
        ds = np.zeros((len(x), h), dtype=np.float32)
        d_in = np.empty((x.shape[1], len(x), 3 * h), dtype=np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            s, z, r, c = keep[t]
            ds = ds + d_states[:, t]
            d_c = ds * z * (1 - c * c)
            d_rs = d_c @ self.candidate.T
            d_g = np.concatenate([ds * (c - s) * z * (1 - z), d_rs * s * r * (1 - r)], axis=1)
            dc += (r * s).T @ d_c
            dg += s.T @ d_g
            d_in[t, :, : 2 * h], d_in[t, :, 2 * h :] = d_g, d_c
            ds = ds * (1 - z) + d_rs * r + d_g @ self.gates.T
        np.add.at(di, x.T.ravel(), d_in.reshape(-1, 3 * h))
        return di, dg, dc


@dataclass
class Model:
    languages: list[str]
    forward: Direction
    back: Direction
    out: np.ndarray  # 2h x languages
    bias: np.ndarray

    def positions(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """n windows of t bytes, `lengths` of them filled -> n x t x languages: the label distribution of every position."""
        h = self.forward.candidate.shape[0]
        z = self.forward.states(x) @ self.out[:h]
        z += turned(self.back.states(turned(x, lengths)) @ self.out[h:], lengths)
        z += self.bias
        z -= z.max(axis=2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=2, keepdims=True)
        return z

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Each text's label probabilities: the mean over all its byte positions (zeros where it has none)."""
        read = [letters(t) for t in texts]
        own, first, last, low, high = [], [], [], [], []  # text, bytes read, bytes labelled
        for k, b in enumerate(read):
            for at in range(0, len(b), WINDOW):
                own.append(k)
                low.append(at)
                high.append(min(at + WINDOW, len(b)))
                first.append(max(0, at - MARGIN))
                last.append(min(high[-1] + MARGIN, len(b)))
        own, first, last, low, high = (np.array(v, dtype=np.int64) for v in (own, first, last, low, high))
        total, count = np.zeros((len(texts), len(self.languages))), np.array([len(b) for b in read])
        order = np.argsort(last - first, kind="stable")
        for lo in range(0, len(order), SIDE_BY_SIDE):
            k = order[lo : lo + SIDE_BY_SIDE]
            lengths = last[k] - first[k]
            x = np.zeros((len(k), int(lengths.max())), dtype=np.uint8)
            for row, i in enumerate(k.tolist()):
                x[row, : lengths[row]] = read[own[i]][first[i] : last[i]]
            t = np.arange(x.shape[1])[None]
            labelled = (t >= (low - first)[k][:, None]) & (t < (high - first)[k][:, None])
            np.add.at(total, own[k], np.einsum("ntk,nt->nk", self.positions(x, lengths), labelled.astype(np.float32)))
        return total / np.maximum(count, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and score of each text; `und` and 0 where it is null or has no letter."""
        known = [k for k, t in enumerate(texts) if self.languages and t and has_letter(t)]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for k, p in zip(known, self.pooled([texts[k] for k in known]), strict=True):
            langs[k], scores[k] = self.languages[int(p.argmax())], min(1.0, float(p.max()))
        return langs, scores

    def column(self, text: Column) -> Column:
        """struct<lang, score> of each text; `und` with score 0 where it is null or has no letter."""
        model = self

        @pandas_udf("lang string, score double")
        def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for s in it:
                texts, out, lo, size = s.tolist(), ([], []), 0, 0
                for hi, t in enumerate(texts, 1):
                    size += len(t or "")
                    if size > 1_000_000 or hi == len(texts):
                        for a, b in zip(out, model.predict(texts[lo:hi]), strict=True):
                            a.extend(b)
                        lo, size = hi, 0
                yield pd.DataFrame({"lang": out[0], "score": out[1]})

        return run(text.cast("string"))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit_texts(texts: list[str], langs: list[str], hidden: int = 6, steps: int = 250, batch: int = 256, span: int = 48, rate: float = 0.03, seed: int = 3) -> Model:
    """Train on labelled texts by Adam; each step reads `batch` stretches of `span` bytes, languages alike."""
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    n = len(languages)

    def direction() -> Direction:
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        return Direction(draw(256, 3 * hidden, s=0.3), draw(hidden, 2 * hidden, s=0.3), draw(hidden, hidden, s=0.3))

    m = Model(languages, direction(), direction(), (rng.standard_normal((2 * hidden, n)) * 0.3).astype(np.float32), np.zeros(n, dtype=np.float32))
    by_lang = [[b for t, k in zip(texts, langs, strict=True) if k == lang and len(b := letters(t))] for lang in languages]
    if n < 2 or not all(by_lang):
        return m
    shares = [np.cumsum([len(b) for b in own]) / sum(len(b) for b in own) for own in by_lang]
    params = [m.forward.inputs, m.forward.gates, m.forward.candidate, m.back.inputs, m.back.gates, m.back.candidate, m.out, m.bias]
    one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = np.arange(batch) % n
        x, lengths = np.zeros((batch, span), dtype=np.uint8), np.zeros(batch, dtype=np.int64)
        for row, k in enumerate(y.tolist()):
            b = by_lang[k][min(int(np.searchsorted(shares[k], rng.random())), len(by_lang[k]) - 1)]
            at = int(rng.integers(0, max(1, len(b) - span + 1)))
            part = b[at : at + span]
            x[row, : len(part)], lengths[row] = part, len(part)
        kept_f: list = []
        kept_b: list = []
        back = turned(x, lengths)
        s = np.concatenate([m.forward.states(x, kept_f), turned(m.back.states(back, kept_b), lengths)], axis=2)
        z = s @ m.out + m.bias
        p = np.exp(z - z.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[np.arange(batch), :, y] -= 1
        p *= (np.arange(span)[None] < lengths[:, None])[:, :, None]
        p /= lengths.sum()
        ds = p @ m.out.T
        grads = [*m.forward.backward(x, kept_f, ds[:, :, :hidden]), *m.back.backward(back, kept_b, turned(ds[:, :, hidden:], lengths)), np.einsum("nth,ntk->hk", s, p), p.sum(axis=(0, 1))]
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)) + 0.05)
        for w, g, a, b in zip(params, grads, one, two, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


def fit(docs: DataFrame, max_rows: int = 1500, max_chars: int = 20_000, test_mod: int = 4, test_rem: int = 2, **options) -> Model:
    """Fit on text and lang of at most `max_rows` rows of at most `max_chars` characters, those with the smallest digests of their ids.

    Rows with null doc_id, text or lang, and rows whose crc32(doc_id as text) mod `test_mod` is `test_rem`, are never
    learnt from. With no rows left, or one language only, nothing is trained: the model knows no language and calls every
    text `und`, or always tells that one.
    """
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    ok = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= max_chars) & (key % test_mod != test_rem))
    total = ok.count()
    digest = F.crc32(F.concat(F.lit("sample:"), F.col("doc_id").cast("string")).cast("binary"))
    share = min(1.0, 1.5 * max_rows / max(total, 1))
    rows = ok.where(digest <= int(share * 2**32)).orderBy(digest, "doc_id", "lang", "text").limit(max_rows).collect()
    return fit_texts([r["text"] for r in rows], [r["lang"] for r in rows], **options)


def predict(docs: DataFrame, model: Model, test_mod: int = 4, test_rem: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; other columns are not read.

    Rows that repeat, or share a doc_id, each get their own row; equal texts get equal answers. A null doc_id is not held
    out. Of equal probabilities the language first in order is told. An empty table gives an empty result. Texts of any
    length, and words of any length in them, are read whole.
    """
    bound_batches(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % test_mod == test_rem, F.lit(False))
    out = docs.select("doc_id", held.alias("held_out"), model.column(F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_known(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose language is told with at least that score; `und` goes.

    Each row is judged by its text alone, so repeated rows stay or go together; an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    p = model.column(F.col("text"))
    return docs.where((p["lang"] != UNKNOWN) & (p["score"] >= least))
