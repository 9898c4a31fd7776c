"""Approximate nearest neighbours by inner product: score-aware anisotropic quantisation, four-bit tables, exact reranking.

Each vector is cut into blocks of `block` dimensions and each block is coded by one of 16 centroids. Centroids and codes
minimise  eta * |parallel residual|^2 + |orthogonal residual|^2  with the parallel part taken along the whole vector: an
error along the vector changes its large inner products, one across it hardly does. Codes are chosen by coordinate
descent over the blocks, centroids by the joint least squares that this loss gives.

What the codes leave of a vector is coded again in the same way, brought to one size and without regard to direction, and
once more. A search builds a table of 16 inner products a block for each query and adds up the entries that the first
codes name, over all candidates. What coding can have done to a sum is bounded by the residuals' lengths: only candidates
that may be among the k best by the first sums have the finer codes added, and only those that may be so by the finer
bounds, against the k-th best of the whole table, are scored exactly. So copies with equal codes and near copies are not
lost. Queries and codes meet in bounded blocks; vectors are joined to what is left of the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .vectors import matrix, usable

CODES = 16
ASKED, SCANNED = 1024, 8192  # queries a block; candidates whose sums are held at a time
LEAST = np.float32(1e-37)  # what single precision may lose near zero


@dataclass
class Quantiser:
    """`blocks` is even, so that two four-bit codes fill a byte."""

    centroids: np.ndarray  # blocks x 16 x block dimensions
    eta: float

    @property
    def blocks(self) -> int:
        return self.centroids.shape[0]

    def split(self, x: np.ndarray) -> np.ndarray:
        """n x d -> n x blocks x block dimensions, with zeros behind."""
        b, _, w = self.centroids.shape
        return np.pad(x, ((0, 0), (0, b * w - x.shape[1]))).reshape(len(x), b, w)

    def encode(self, x: np.ndarray, rounds: int = 3, start: np.ndarray | None = None) -> np.ndarray:
        """n x blocks uint8 codes."""
        norm = np.linalg.norm(x, axis=1)
        norm[norm == 0] = 1
        p, u = self.split(x), self.split(x / norm[:, None])
        c = self.centroids
        # squared error and error along the vector, of each block and each code
        square = ((p**2).sum(2)[:, :, None] - 2 * np.einsum("nbw,bkw->nbk", p, c) + (c**2).sum(2)[None]).astype(np.float32)
        along = ((u * p).sum(2)[:, :, None] - np.einsum("nbw,bkw->nbk", u, c)).astype(np.float32)
        codes = square.argmin(2) if start is None else start.astype(np.int64)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(rounds if self.eta != 1 else 0):  # without regard to direction, each block stands alone
            for b in range(self.blocks):
                rest = total - along[rows, b, codes[:, b]]
                codes[:, b] = (square[:, b] + (self.eta - 1) * (rest[:, None] + along[:, b]) ** 2).argmin(1)
                total = rest + along[rows, b, codes[:, b]]
        return codes.astype(np.uint8)

    def rest(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """n x (blocks * block dimensions): what the codes leave."""
        return (self.split(x) - self.centroids[np.arange(self.blocks)[None], codes]).reshape(len(x), -1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries -> n x blocks x 16 inner products."""
        return np.einsum("nbw,bkw->nbk", self.split(q), self.centroids).astype(np.float32)

    @staticmethod
    def packed(codes: np.ndarray) -> np.ndarray:
        """Two codes a byte: n x blocks / 2."""
        return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def byte_tables(self, q: np.ndarray) -> np.ndarray:
        """bytes x queries x 256: the sums that a byte's two codes stand for."""
        t = self.tables(q)
        pairs = t[:, 1::2, :, None] + t[:, ::2, None, :]
        return np.ascontiguousarray(pairs.reshape(len(q), -1, CODES * CODES).transpose(1, 0, 2))

    def scan(self, q: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products, queries x candidates: the table entries that the packed codes name, added up."""
        out = np.zeros((len(q), len(packed)), dtype=np.float32)
        for table, byte in zip(self.byte_tables(q), packed.T, strict=True):
            out += table[:, byte]
        return out


def train(x: np.ndarray, block: int = 2, eta: float = 4.0, rounds: int = 6, seed: int = 5) -> Quantiser:
    """Alternate codes and centroids on the sample x."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    blocks = -(-d // (2 * block)) * 2
    q = Quantiser(np.zeros((blocks, CODES, block)), eta)
    if not len(x):
        return q
    parts = q.split(x)
    q.centroids = np.stack([parts[rng.integers(0, len(x), CODES), b] for b in range(blocks)]) + rng.standard_normal((blocks, CODES, block)) * 1e-6
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = q.split(x / np.where(norm == 0, 1, norm))
    size, codes = blocks * CODES * block, None
    for _ in range(rounds):
        codes = q.encode(x, start=codes)
        at = (np.arange(blocks)[None] * CODES + codes)[:, :, None] * block + np.arange(block)  # n x blocks x block: places of a row's centroids
        weights = np.bincount(at.ravel(), minlength=size).astype(np.float64)
        target = np.bincount(at.ravel(), parts.ravel(), minlength=size)
        if eta == 1:
            q.centroids = ((target + 1e-6 * q.centroids.ravel()) / (weights + 1e-6)).reshape(blocks, CODES, block)
            continue
        system = np.zeros((size, size))
        for lo in range(0, len(x), 2048):  # sum of (selected u)(selected u)^T
            z = np.zeros((len(x[lo : lo + 2048]), size), dtype=np.float32)
            np.put_along_axis(z, at[lo : lo + 2048].reshape(len(z), -1), u[lo : lo + 2048].reshape(len(z), -1).astype(np.float32), 1)
            system += (eta - 1) * (z.T @ z)
            target += (eta - 1) * (z.T @ norm[lo : lo + 2048, 0].astype(np.float32))
        system[np.arange(size), np.arange(size)] += weights + 1e-6
        q.centroids = np.linalg.solve(system, target + 1e-6 * q.centroids.ravel()).reshape(blocks, CODES, block)
    return q


@dataclass
class Levels:
    """The first quantiser and those of what the ones before it leave."""

    quantisers: list[Quantiser]

    @staticmethod
    def scale(rest: np.ndarray) -> np.ndarray:
        """n x 1: each row's largest component, which brings its residual to one size."""
        most = np.abs(rest).max(axis=1, initial=0.0, keepdims=True)
        return np.where(most == 0, 1, most).clip(1e-30, 1e30).astype(np.float32).astype(np.float64)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """codes: n x levels x bytes. errors: n x 2 x blocks, lengths of what is left of each block after the first and the
        last level, in 255 steps, rounded up. numbers: n x (levels + 2) float32: the sizes of the levels after the first,
        the steps of both errors, and what rounding may add."""
        with np.errstate(over="ignore", invalid="ignore"):  # what single precision cannot hold is left open by the search
            return self._encode(x)

    def _encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, errors, numbers = [], [], []
        slack, rest, size = np.linalg.norm(x, axis=1), x, np.ones((len(x), 1))
        for level, quantiser in enumerate(self.quantisers):
            if level:
                size = self.scale(rest)
                numbers.append(size[:, 0])
            own = quantiser.encode(rest / size)
            rest = quantiser.rest(rest / size, own) * size
            left = np.linalg.norm(quantiser.split(rest), axis=2)
            slack = slack + 2 * np.linalg.norm(left, axis=1)
            codes.append(quantiser.packed(own))
            if level in (0, len(self.quantisers) - 1):
                step = left.max(axis=1, initial=0.0) / 255
                errors.append((step, np.ceil(left / np.where(step == 0, 1, step)[:, None]).clip(0, 255).astype(np.uint8)))
        errors = [errors[0], errors[-1]]
        return np.stack(codes, axis=1), np.stack([e for _, e in errors], axis=1), np.stack([*numbers, *[e for e, _ in errors], 1e-5 * slack], axis=1).astype(np.float32)


def fit(vectors: DataFrame, dims: int, sample_rows: int = 8192, levels: int = 4, **options) -> Levels:
    """Train on at most `sample_rows` vectors, those with the smallest digests of their ids. Vectors with components of 1e15
    or more teach nothing, as their squares leave single precision; they are coded and searched all the same."""
    small = vectors.where(F.forall("embedding", lambda v: F.abs(v) < 1e15))
    rows = small.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").collect()
    rest, out = np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(len(rows), dims), []
    for _ in range(levels):
        out.append(train(rest / Levels.scale(rest), **(options | {"eta": 1.0})) if out else train(rest, **options))
        size = Levels.scale(rest) if len(out) > 1 else 1.0
        rest = out[-1].rest(rest / size, out[-1].encode(rest / size)) * size
    return Levels(out)


def search(embeddings: DataFrame, queries: DataFrame, k: int = 20, rerank: int = 200, block_rows: int = 65536, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of `embeddings` for each row of `queries`, the query's own vec_id apart.

    Both have (vec_id, embedding). Null, zero or unfinished vectors and rows without vec_id take no part; vectors of each
    length are searched among themselves. Rows that repeat a vec_id with the same vector count once; with another vector,
    each counts. Equal scores go by vec_id. Fewer candidates than k: all of them. Empty tables: empty result.
    Equal vectors are one candidate, which stands for its k + 1 smallest vec_ids. A query meets `block_rows` candidates at a
    time. It adds the finer codes for its `rerank` candidates with the largest first sums, then for every other one whose
    first bound reaches the k-th best lower bound so far, and passes on what still may be among the block's k best; of
    these, all that reach the k-th best lower bound of the whole table are scored in double precision and ranked.
    """
    clean = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    clean = save(clean.dropDuplicates(["vec_id", "embedding"]), "vectors")
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).dropDuplicates(["vec_id", "embedding"])
    asked = save(asked.withColumn("ask", F.monotonically_increasing_id()), "queries")
    lengths = sorted(r["d"] for r in asked.select(F.size("embedding").alias("d")).distinct().collect())  # a few numbers
    own = lambda rows, d: rows.where(F.size("embedding") == d)
    found = [one_length(own(clean, d), own(asked, d), d, k, rerank, block_rows, **options) for d in lengths]
    if not found:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def bounds(clean: DataFrame, asked: DataFrame, dims: int, k: int, rerank: int, block_rows: int, **options) -> tuple[DataFrame, DataFrame]:
    """coded(at, ids, embedding, ...), one row a class of equal vectors, and pairs(ask, at, low, high): what codes alone say
    of the inner products of all pairs that may be among a query's k best of their block, among vectors of one length."""
    stack = fit(clean, dims, **options)
    depth, first = len(stack.quantisers), stack.quantisers[0]
    nth = Window.partitionBy("embedding").orderBy("vec_id")
    few = clean.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k + 1)  # the query's own row and k others
    classes = save(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "classes")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Once for each candidate."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                told = [pa.array([row.tobytes() for row in values], pa.binary()) for values in stack.encode(matrix(part.column(1), dims))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *told], names=["ids", "embedding", "codes", "errors", "numbers"])

    coded = classes.select("ids", "embedding").mapInArrow(encode, "ids array<long>, embedding array<double>, codes binary, errors binary, numbers binary")
    coded = save(coded.withColumn("at", F.monotonically_increasing_id()), "coded")
    n_c, n_q = max(1, -(-classes.count() // block_rows)), max(1, -(-asked.count() // min(block_rows, ASKED)))
    block = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    alone = F.when(F.size("ids") == 1, F.col("ids")[0])
    left = coded.select("at", alone.alias("alone"), "codes", "errors", "numbers", block("at", n_c).alias("c"), every(n_q).alias("q"))
    right = asked.select("ask", "vec_id", "embedding", block("ask", n_q).alias("q"), every(n_c).alias("c"))

    def told(cands: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = {"ask": [], "at": [], "low": [], "high": []}
        if len(cands) and len(asks):
            n, at = len(cands), cands["at"].to_numpy()
            single = cands["alone"].notna().to_numpy()
            own = cands["alone"].astype("Int64").fillna(0).to_numpy(dtype=np.int64)
            codes = np.frombuffer(b"".join(cands["codes"]), dtype=np.uint8).reshape(n, depth, -1)
            errors = np.frombuffer(b"".join(cands["errors"]), dtype=np.uint8).reshape(n, 2, -1)
            numbers = np.frombuffer(b"".join(cands["numbers"]), dtype=np.float32).reshape(n, -1)
            sizes, slack = numbers[:, : depth - 1], numbers[:, -1]
            once, last = (errors[:, j].astype(np.float32) * numbers[:, depth - 1 + j, None] for j in (0, 1))
            places = np.arange(codes.shape[2])
            ids, q = asks[["ask", "vec_id"]].to_numpy(), np.stack(asks["embedding"].to_numpy())
            for lo in range(0, len(q), 256):
                part = q[lo : lo + 256]
                finer = [f.byte_tables(part) for f in stack.quantisers[1:]]
                lengths = np.linalg.norm(first.split(part), axis=2).astype(np.float32)
                norms = np.linalg.norm(part, axis=1).astype(np.float32)

                def refined(i: int, rows: np.ndarray, total: np.ndarray, finer=finer, lengths=lengths, norms=norms) -> np.ndarray:
                    """Row, lower and upper bound by all levels; sums that single precision cannot hold bound nothing."""
                    for level, tables in enumerate(finer):
                        total = total + sizes[rows, level] * tables[:, i][places, codes[rows, level + 1]].sum(1)
                    wide = last[rows] @ lengths[i] + norms[i] * slack[rows] + LEAST
                    low, high = (total - wide).astype(np.float64), (total + wide).astype(np.float64)
                    good = np.isfinite(low) & np.isfinite(high)
                    return np.stack([rows, np.where(good, low, -np.inf), np.where(good, high, np.inf)])

                def pruned(found: np.ndarray) -> tuple[np.ndarray, float]:
                    """What of `found` may be among the k best of it, and the k-th lower bound."""
                    if found.shape[1] < k:
                        return found, -np.inf
                    reach = np.partition(found[1], -k)[-k]
                    return found[:, found[2] >= reach], reach

                open_ = [(np.zeros((3, 0)), -np.inf)] * len(part)
                for at_c in range(0, n, SCANNED):
                    some = slice(at_c, at_c + SCANNED)
                    sums = first.scan(part, codes[some, 0])
                    most = sums + lengths @ once[some].T + norms[:, None] * slack[None, some] + LEAST
                    keep = min(rerank + 1, sums.shape[1])
                    for i in range(len(part)):
                        may = ~(single[some] & (own[some] == ids[lo + i, 1]))  # classes with a row that is not the query's own
                        found, reach = open_[i]
                        if reach == -np.inf:
                            rows = np.argpartition(-sums[i], keep - 1)[:keep]
                            rows = rows[may[rows]]
                            may[rows] = False
                            found, reach = pruned(np.concatenate([found, refined(i, at_c + rows, sums[i, rows])], axis=1))
                        rows = np.flatnonzero(may & ~(most[i] < reach))
                        open_[i] = pruned(np.concatenate([found, refined(i, at_c + rows, sums[i, rows])], axis=1))
                for i, (found, _) in enumerate(open_):
                    for name, values in zip(out, (np.full(found.shape[1], ids[lo + i, 0]), at[found[0].astype(np.int64)], found[1], found[2]), strict=True):
                        out[name].append(values)
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, dtype=t) for (c, v), t in zip(out.items(), ("int64", "int64", "float64", "float64"), strict=True)})

    return coded, left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(told, "ask long, at long, low double, high double")


def still_open(pairs: DataFrame, k: int) -> DataFrame:
    """The pairs(ask, at, low, high) whose upper bound reaches the k-th largest lower bound of their query; all, where it has fewer."""
    nth = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("low")))
    reach = pairs.select("ask", "low").withColumn("nth", nth).where(F.col("nth") <= k).groupBy("ask").agg(F.min("low").alias("reach"), F.count(F.lit(1)).alias("n"))
    return pairs.join(reach.where(F.col("n") >= k).select("ask", "reach"), "ask", "left").where(F.col("reach").isNull() | (F.col("high") >= F.col("reach"))).select("ask", "at")


def one_length(clean: DataFrame, asked: DataFrame, dims: int, k: int, rerank: int, block_rows: int, **options) -> DataFrame:
    """query_id, vec_id, score: all pairs that the codes leave open, scored exactly, among usable vectors of one length."""
    coded, pairs = bounds(clean, asked, dims, k, rerank, block_rows, **options)
    left = still_open(save(pairs, "bounds"), k).join(coded.select("at", "ids", "embedding"), "at")
    both = left.join(asked.select("ask", F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "ask").select("query_id", "ids", "embedding", "query")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = (matrix(batch.column(2), dims) * matrix(batch.column(3), dims)).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["query_id", "ids", "score"])

    scored = both.mapInArrow(exact, "query_id long, ids array<long>, score double")
    return scored.select("query_id", F.explode("ids").alias("vec_id"), "score").where(F.col("vec_id") != F.col("query_id"))
