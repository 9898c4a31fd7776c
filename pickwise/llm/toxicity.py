"""Toxicity: a logistic classifier fitted with a counterfactual penalty.

A text's features are the word pieces (whole word, starts, ends, inner runs of five bytes) that occur in it. For
labelled texts that name a group, copies are made in which each identity term is swapped for another of its kind; the
fit penalises the squared change of the score between text and copy, so naming a group does not move the score. An L1
term keeps the pieces few, so long clean texts do not add up small weights.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bound_batches

#: Groups of terms of one kind; a term is swapped for another of its group. A parameter of fit().
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "african", "european", "mexican", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals"), ("disabled", "deaf", "blind"), ("old", "young"),
)

LONG = 40  # bytes of the words that memos keep; longer ones are read whole, each time anew
#: ASCII other than letters becomes a space; bytes above 127 stay, so words of any language hold together.
_KEEP = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.lower().encode(errors="replace").translate(_KEEP).split() if text else []


def word_pieces(word: bytes) -> Iterator[bytes]:
    """The pieces of the whole word, however long; some may come twice."""
    w = b"^" + word + b"$"
    yield w
    for k in range(4, min(8, len(w))):
        yield w[:k]
    yield w[-5:]
    for i in range(1, len(w) - 5):
        yield w[i : i + 5]


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float

    def scorer(self):
        names = list(self.weights)
        ids = {p: i for i, p in enumerate(names)}
        values = [self.weights[p] for p in names]

        class Pieces(dict):
            """word -> ids of its weighted pieces; emptied at a bound, long words (runs without spaces) are not kept."""

            def __missing__(self, word):
                out = tuple(sorted({ids[p] for p in word_pieces(word) if p in ids})) or None
                if len(word) > LONG:
                    return out
                if len(self) >= 60_000:
                    self.clear()
                self[word] = out
                return out

        memo = Pieces()

        def score(text: str | None) -> float:
            found: set[int] = set()
            for hit in filter(None, map(memo.__getitem__, words(text))):
                found.update(hit)
            z = self.bias + math.fsum(values[i] for i in found)
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

        return score

    def column(self, text: Column) -> Column:
        """The score of each text: a double in (0, 1); null and empty texts get the bias alone."""
        model = self

        @pandas_udf("double")
        def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            score = model.scorer()
            for s in it:
                yield pd.Series([score(t) for t in s], dtype="float64")

        return run(text.cast("string"))


def swapped(text: str, groups, rng: random.Random) -> str | None:
    """The text with every identity term swapped for another of its kind; None if it has none."""
    other = {t: [o for o in g if o != t] for g in groups for t in g}
    hit = False

    def change(m: re.Match) -> str:
        nonlocal hit
        if m[0].lower() in other:
            hit = True
            return rng.choice(other[m[0].lower()])
        return m[0]

    out = re.sub(r"[A-Za-z]+", change, text)
    return out if hit else None


def fit_texts(texts: list[str], labels: list[int], groups=IDENTITY_TERMS, penalty: float = 4.0, l1: float = 5e-5, pieces: int = 3000, boost: float = 8.0, copies: int = 2, steps: int = 400, seed: int = 7) -> Model:
    """Fit on labelled texts. With no texts, or one label only, the model is a bias."""
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 0.5) / (len(y) + 1) if len(y) else 0.05
        return Model({}, math.log(share / (1 - share)))
    rng = random.Random(seed)
    named = {b"^" + t.encode() + b"$" for g in groups for t in g}
    # A piece in under three toxic texts gets no weight: counts by hash first, so that the exact ones are few.
    rough = np.zeros(1 << 20, dtype=np.uint32)
    slot = lambda p: zlib.crc32(p) & (len(rough) - 1)
    toxic = [t for t, label in zip(texts, labels, strict=True) if label == 1]
    for t in toxic:
        for k in {slot(p) for w in set(words(t)) for p in word_pieces(w)}:
            rough[k] += 1
    in_toxic: Counter = Counter()
    for t in toxic:
        in_toxic.update({p for w in set(words(t)) for p in word_pieces(w) if rough[slot(p)] >= 3})
    wanted = {p: i for i, p in enumerate(sorted({p for p, c in in_toxic.items() if c >= 3} | named))}
    del rough, in_toxic, toxic

    memo: dict[tuple[int, bytes], tuple[int, ...]] = {}

    def features(text: str, ids: dict[bytes, int]) -> np.ndarray:
        """The numbers of the text's pieces, each once, in order."""
        found: set[int] = set()
        for w in set(words(text)):
            key = (id(ids), w)
            if key not in memo:
                if len(memo) >= 40_000:
                    memo.clear()
                memo[key] = tuple({ids[p] for p in word_pieces(w) if p in ids})
            found.update(memo[key])
        return np.array(sorted(found), dtype=np.int32)

    df = np.zeros((2, len(wanted)))
    for t, label in zip(texts, labels, strict=True):
        df[label, features(t, wanted)] += 1
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    share = df.sum(axis=0) / (n1 + n0)
    z = (df[1] / n1 - df[0] / n0) / np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-9)
    pieces_of = list(wanted)
    rank = [i for i in np.lexsort((np.arange(len(z)), -z)).tolist() if df[1, i] >= 3 and z[i] > 4]
    names = list(dict.fromkeys([pieces_of[i] for i in rank[:pieces]] + sorted(p for p in named if df[:, wanted[p]].sum())))
    ids = {p: i for i, p in enumerate(names)}
    del df, z, share, wanted, pieces_of

    def table(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all rows one after another, and the row of each."""
        return np.concatenate([np.zeros(0, dtype=np.int32), *rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    at, row_of = table([features(t, ids) for t in texts])
    plus, minus = [], []
    for t in texts:
        for _ in range(copies):
            if (s := swapped(t, groups, rng)) is not None:
                a, b = features(t, ids), features(s, ids)
                plus.append(np.setdiff1d(a, b))
                minus.append(np.setdiff1d(b, a))
    pairs = len(plus)
    up_at, up_of = table(plus)
    down_at, down_of = table(minus)
    weight = np.where(y == 1, min(boost, n0 / n1), 1.0)
    weight /= weight.sum()
    w, bias = np.zeros(len(names)), float(math.log(n1 / n0))
    m, v, mb, vb, rate = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0.05
    total = lambda where, of, size: np.bincount(where, of, minlength=size)
    for step in range(1, steps + 1):
        g = (1 / (1 + np.exp(-(total(row_of, w[at], len(y)) + bias))) - y) * weight
        gw, gb = total(at, g[row_of], len(w)), float(g.sum())
        if pairs:
            change = total(up_of, w[up_at], pairs) - total(down_of, w[down_at], pairs)
            gw = gw + 2 * penalty / pairs * (total(up_at, change[up_of], len(w)) - total(down_at, change[down_of], len(w)))
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        w = w - scale * m / (1 - 0.9**step)
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(scale * l1, 0.02), 0)
        bias -= rate * mb / (1 - 0.9**step) / (math.sqrt(vb / (1 - 0.99**step)) + 1e-5)
    return Model({p: float(a) for p, a in zip(names, w, strict=True) if abs(a) > 1e-4}, bias)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, max_chars: int = 20_000, test_mod: int = 3, test_rem: int = 1, **options) -> Model:
    """Fit on labels(doc_id, toxic) joined to docs(doc_id, text), on a sample of at most `max_rows` labelled rows, of which
    those with texts of over `max_chars` characters are left out.

    Rows whose crc32(doc_id as text) mod `test_mod` is `test_rem` are never learnt from, nor are null labels, ids and
    texts. The sample is the rows with the smallest digests of their ids, so it is the same at every run.
    """
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    ok = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (key % test_mod != test_rem))
    ids = ok.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "toxic").limit(max_rows)
    rows = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(ids), "doc_id")  # at most max_rows ids
    rows = rows.dropDuplicates(["doc_id", "toxic", "text"]).orderBy("doc_id", "toxic", "text").limit(max_rows).collect()
    return fit_texts([r["text"] for r in rows], [r["toxic"] for r in rows], **options)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, test_mod: int = 3, test_rem: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, null and empty texts included; other columns are not read.

    Rows that repeat, or share a doc_id, each get their own row; equal texts get equal scores. A null doc_id is not held
    out. A score of exactly the threshold is predicted 1. An empty table gives an empty result. Texts and words of any
    length are read whole.
    """
    bound_batches(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % test_mod == test_rem, F.lit(False))
    out = docs.select("doc_id", held.alias("held_out"), model.column(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns.

    Each row is judged by its text alone, so repeated rows stay or go together, and null and empty texts by the model's
    bias; an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    return docs.where(model.column(F.col("text")) < threshold)
