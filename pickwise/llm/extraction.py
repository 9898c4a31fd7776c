"""HTML extraction: a recurrent labeller of blocks.

Every leaf block of a page becomes a vector: hashed names of its tag path, hashed words of its whole text, and a few
measures. A bidirectional LSTM reads a page's blocks in order, so each block is judged in the context of the whole
document, and gives the probability that the block belongs to the main text. Network and training are numpy; the
training pages are laid out by rule (`layouts.page`), where every block's label is known.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bound_batches
from .html_blocks import Block, blocks
from .layouts import page as lay_out

BUCKETS = 4096
PATH, WORDS, MEASURES = 24, 8, 6


class Hashes(dict):
    """name -> bucket; emptied at a bound."""

    def __missing__(self, name: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[name] = k = zlib.crc32(name.encode(errors="replace")) % BUCKETS
        return k


HASHES = Hashes()


def path_names(block: Block) -> list[str]:
    names = {n if i else f"<{n}>" for e in block.path for i, n in enumerate(e)}
    if block.path:
        names.add(f"last:{block.path[-1][0]}")
        names.update(f"last.{n}" for n in block.path[-1][1:])
    return sorted(names)


@dataclass
class Page:
    path_ids: np.ndarray  # of all blocks, one after another
    path_at: np.ndarray  # block of each
    word_ids: np.ndarray
    word_at: np.ndarray
    measures: np.ndarray

    @classmethod
    def of(cls, found: list[Block]) -> "Page":
        paths = [[HASHES[n] for n in path_names(b)] for b in found]
        words = [[HASHES["w " + w] for w in b.text.lower().split()] for b in found]
        flat = lambda x: (np.array([i for own in x for i in own], dtype=np.int32), np.repeat(np.arange(len(x)), [len(own) for own in x]))
        m = np.array([[min(12.0, np.log1p(len(b.text))) / 6, b.linked / max(1, len(b.text)), min(1.0, b.text.count(". ") / 5), float(b.text[-1] in ".!?"), i / len(found), min(1.0, len(b.path) / 10)] for i, b in enumerate(found)], dtype=np.float32)
        return cls(*flat(paths), *flat(words), m.reshape(len(found), MEASURES))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Lstm:
    def __init__(self, inputs: int, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.w = (rng.standard_normal((inputs + hidden, 4 * hidden)) / np.sqrt(inputs + hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, dtype=np.float32)
        self.b[hidden : 2 * hidden] = 1

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: n x t x inputs -> n x t x hidden."""
        h = self.h
        a = x @ self.w[: x.shape[2]] + self.b
        s = c = np.zeros((len(x), h), dtype=np.float32)
        out = np.empty((*x.shape[:2], h), dtype=np.float32)
        for t in range(x.shape[1]):
            g = a[:, t] + s @ self.w[x.shape[2] :]
            io = sigmoid(g[:, : 3 * h])
            i, f, o, u = io[:, :h], io[:, h : 2 * h], io[:, 2 * h :], np.tanh(g[:, 3 * h :])
            if keep is not None:
                keep.append((s, c, i, f, o, u))
            c = f * c + i * u
            s = o * np.tanh(c)
            out[:, t] = s
        return out

    def backward(self, x: np.ndarray, keep: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, d = self.h, x.shape[2]
        dw, db, dx = np.zeros_like(self.w), np.zeros_like(self.b), np.zeros_like(x)
        ds = dc = np.zeros((len(x), h), dtype=np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            s, c0, i, f, o, u = keep[t]
            tc = np.tanh(f * c0 + i * u)
            ds = ds + d_out[:, t]
            dc = dc + ds * o * (1 - tc * tc)
            g = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
            dw[:d] += x[:, t].T @ g
            dw[d:] += s.T @ g
            db += g.sum(axis=0)
            dx[:, t] = g @ self.w[:d].T
            ds, dc = g @ self.w[d:].T, dc * f
        return dw, db, dx


class Labeller:
    def __init__(self, hidden: int = 16, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.paths = (rng.standard_normal((BUCKETS, PATH)) * 0.1).astype(np.float32)
        self.words = (rng.standard_normal((BUCKETS, WORDS)) * 0.1).astype(np.float32)
        self.ahead, self.back = (Lstm(PATH + WORDS + MEASURES, hidden, rng) for _ in range(2))
        self.out, self.bias = np.zeros(2 * hidden + PATH + WORDS + MEASURES, dtype=np.float32), np.zeros(1, dtype=np.float32)

    def vectors(self, p: Page) -> np.ndarray:
        n = len(p.measures)
        x = np.zeros((n, PATH + WORDS + MEASURES), dtype=np.float32)
        for table, ids, at, lo, hi in ((self.paths, p.path_ids, p.path_at, 0, PATH), (self.words, p.word_ids, p.word_at, PATH, PATH + WORDS)):
            count = np.bincount(at, minlength=n).astype(np.float32)
            if len(ids):
                starts = np.flatnonzero(np.diff(at, prepend=-1))
                x[at[starts], lo:hi] = np.add.reduceat(table[ids], starts, axis=0)
            if lo:
                x[:, lo:hi] /= np.maximum(count, 1)[:, None]
        x[:, PATH + WORDS :] = p.measures
        return x

    @staticmethod
    def turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each row's own part in reverse order; its own inverse."""
        t = np.arange(x.shape[1])[None]
        back = np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)
        return np.take_along_axis(x, back[:, :, None], axis=1)

    def padded(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(p.measures) for p in pages])
        x = np.zeros((len(pages), int(lengths.max()), PATH + WORDS + MEASURES), dtype=np.float32)
        for i, p in enumerate(pages):
            x[i, : lengths[i]] = self.vectors(p)
        return x, lengths

    def logits(self, x: np.ndarray, lengths: np.ndarray, keep: tuple[list, list] | tuple[None, None] = (None, None)) -> tuple[np.ndarray, np.ndarray]:
        s = np.concatenate([self.ahead.states(x, keep[0]), self.turned(self.back.states(self.turned(x, lengths), keep[1]), lengths), x], axis=2)
        return s @ self.out + self.bias[0], s

    def probabilities(self, pages: list[Page], most: int = 30_000) -> list[np.ndarray]:
        """The probability of each block of each page; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i].measures)), key=lambda i: len(pages[i].measures))
        while order:
            longest = len(pages[order[-1]].measures)
            n = max(1, most // longest)
            own, order = order[-n:], order[:-n]
            x, lengths = self.padded([pages[i] for i in own])
            z = sigmoid(self.logits(x, lengths)[0])
            for k, i in enumerate(own):
                out[i] = z[k, : lengths[k]]
        return out

    def train(self, pages: list[Page], labels: list[np.ndarray], steps: int = 260, batch: int = 16, rate: float = 0.01, seed: int = 4) -> "Labeller":
        rng = np.random.default_rng(seed)
        params = [self.paths, self.words, self.ahead.w, self.ahead.b, self.back.w, self.back.b, self.out, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        h = self.ahead.h
        for step in range(1, steps + 1):
            own = rng.choice(len(pages), min(batch, len(pages)), replace=False)
            x, lengths = self.padded([pages[i] for i in own])
            keep: tuple[list, list] = ([], [])
            z, s = self.logits(x, lengths, keep)
            real = np.arange(x.shape[1])[None] < lengths[:, None]
            y = np.zeros_like(z)
            for k, i in enumerate(own):
                y[k, : lengths[k]] = labels[i]
            dz = np.where(real, sigmoid(z) - y, 0).astype(np.float32) / real.sum()
            ds = dz[:, :, None] * self.out
            wa, ba, xa = self.ahead.backward(x, keep[0], ds[:, :, :h])
            wb, bb, xb = self.back.backward(self.turned(x, lengths), keep[1], self.turned(ds[:, :, h : 2 * h], lengths))
            dx = xa + self.turned(xb, lengths) + ds[:, :, 2 * h :]
            dp, dword = np.zeros_like(self.paths), np.zeros_like(self.words)
            for k, i in enumerate(own):
                p = pages[i]
                np.add.at(dp, p.path_ids, dx[k, p.path_at, :PATH])
                count = np.maximum(np.bincount(p.word_at, minlength=lengths[k]), 1).astype(np.float32)
                np.add.at(dword, p.word_ids, dx[k, p.word_at, PATH : PATH + WORDS] / count[p.word_at][:, None])
            grads = [dp, dword, wa, ba, wb, bb, np.einsum("nt,nth->h", dz, s), dz.sum(keepdims=True)[0]]
            lr = rate * min(1.0, 2.2 * (1 - step / (steps + 1)) + 0.05)
            for w, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def fit(pages: int = 420, seed: int = 1, **options) -> Labeller:
    """Train on `pages` pages laid out by rule; the same model at every run."""
    rng = np.random.default_rng(seed)
    found, labels = [], []
    for _ in range(pages):
        source, marked = lay_out(rng)
        own = blocks(source)
        if own:
            found.append(Page.of(own))
            labels.append(np.array([marked(b.text) for b in own], dtype=np.float32))
    return Labeller().train(found, labels, **options)


def main_text(html: list[str | None], model: Labeller, least: float = 0.5) -> list[str]:
    found = [blocks(h) for h in html]
    probabilities = model.probabilities([Page.of(b) for b in found])
    return ["\n".join(b.text for b, p in zip(own, ps, strict=True) if p >= least) for own, ps in zip(found, probabilities, strict=True)]


def text_column(html: Column, model: Labeller) -> Column:
    """The main text of each page; empty where the page is null, empty or has none."""

    @pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            pages, out, lo, size = s.tolist(), [], 0, 0
            for hi, p in enumerate(pages, 1):
                size += len(p or "")
                if size > 2_000_000 or hi == len(pages):
                    out += main_text(pages[lo:hi], model)
                    lo, size = hi, 0
            yield pd.Series(out, dtype=object)

    return run(html.cast("string"))


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html).

    Rows that repeat, or share a page_id, are each extracted; equal pages give equal texts. Null ids and urls stay null; a
    null or empty page, or one without main text, has an empty text. A block is main text from a probability of 0.5 on.
    Pages of any length are read whole. An empty table gives an empty result; other columns, also such as are called text
    or n_chars, are not read.
    """
    bound_batches(pages.sparkSession)
    return pages.select("page_id", "url", text_column(F.col("html"), model).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def label_blocks(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, block, text, path, probability: every leaf block of every page with what the network says.

    A page without blocks, a null one among them, has no rows; rows that repeat are each labelled. An empty table gives an
    empty result.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            for lo in range(0, len(df), 200):
                part = df.iloc[lo : lo + 200]
                found = [blocks(h) for h in part["html"]]
                ps = model.probabilities([Page.of(b) for b in found])
                yield pd.DataFrame([(i, k, b.text, "/".join(".".join(e) for e in b.path), float(q)) for i, own, p in zip(part["page_id"], found, ps, strict=True) for k, (b, q) in enumerate(zip(own, p, strict=True))], columns=["page_id", "block", "text", "path", "probability"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, block int, text string, path string, probability double")
