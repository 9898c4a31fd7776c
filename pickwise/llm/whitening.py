"""Whitening of embeddings by matrix-free block Lanczos.

The covariance of the whole table is never formed. The driver holds a block of at most BLOCK directions V; one pass over
the rows returns the sum of xᵀ(xV), rows centred first: every task adds up its own rows and gives a sum for each of the
BLOCK x dimensions cells, which Spark adds by cell. New directions are orthogonalised against all earlier ones, twice. A
direction that the block has used up (breakdown) is replaced by a random one outside the basis. Passes end when the
residuals |AQy - eQy| of all wanted pairs, taken from the stored AQ, are down to rounding, and stay there when a random
block outside the basis has been added (an eigenvalue may be more often there than the blocks so far could show), or the
basis fills the space.

Each length of vectors is a fit list of its own. What the driver holds grows with the square of the vectors' length, not
with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, save
from .vectors import lists, matrix

BLOCK = 16
SCALE, SHIFT, LIMIT = 64, 1_000_000, 2**60  # x = floor(SCALE * c) + SHIFT, products held within +-LIMIT
ROUNDING = 64 * np.finfo(float).eps
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def finite(embedding: Column) -> Column:
    """Not null, and no null or non-finite component."""
    x = embedding.cast("array<double>")
    return F.coalesce(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def integers(embedding: Column) -> Column:
    """The vector in whole units; components beyond 2**60 units count as 2**60."""
    unit = lambda v: F.floor(F.least(F.greatest(v * SCALE, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))) + SHIFT
    return F.transform(embedding.cast("array<double>"), unit)


def exact_sums(rows: DataFrame, dims: int) -> list[int]:
    """Per-dimension sums of rows(x) as whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), dtype=np.int64).reshape(-1, dims)
            if len(x):
                wide = int(np.abs(x).max()) * len(x) >= 2**62
                total = [a + int(b) for a, b in zip(total, x.astype(object).sum(0) if wide else x.sum(0), strict=True)]
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(dims), pa.int32()), "part": pa.array(map(Decimal, total), pa.decimal128(38, 0))})

    summed = rows.select("x").mapInArrow(run, "cell int, part decimal(38,0)").groupBy("cell").agg(F.sum("part").alias("total"))
    found = {r["cell"]: int(r["total"]) for r in summed.collect()}  # one row a dimension
    return [found[i] for i in range(dims)]


def added(rows: DataFrame, width: int, cells: int, value: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over blocks of rows(one array column of `width`) of value(block), `cells` numbers; one row a cell comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            if batch.num_rows:
                total += value(matrix(batch.column(0), width)).reshape(-1)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(cells), pa.int32()), "part": pa.array(total)})

    summed = rows.mapInArrow(run, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("total"))
    out = np.zeros(cells)
    for r in summed.collect():
        out[r["cell"]] = r["total"]
    return out


def lanczos(apply: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, block: int = BLOCK, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """The `wanted` largest eigenvalues, falling, their unit vectors as columns, and the passes taken, of a symmetric
    operator without negative eigenvalues that is known only by apply(V) = AV."""
    rng = np.random.default_rng(seed)
    basis, image = np.zeros((dims, 0)), np.zeros((dims, 0))
    fresh, passes, settled = rng.standard_normal((dims, min(block, dims))), 0, False
    while True:
        new = outside(basis, fresh, min(block, dims - basis.shape[1]), rng)
        image = np.hstack([image, apply(new)])
        basis, passes = np.hstack([basis, new]), passes + 1
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(-values, kind="stable")[:wanted]
        ritz = basis @ vectors[:, top]
        residual = np.linalg.norm(image @ vectors[:, top] - ritz * values[top], axis=0)
        before, settled = settled, len(top) == wanted and residual.max() <= ROUNDING * max(values.max(), 0)
        if basis.shape[1] == dims or before and settled:
            return values[top], ritz, passes
        fresh = rng.standard_normal(new.shape) if settled else image[:, -new.shape[1] :]


def outside(basis: np.ndarray, fresh: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """At most `most` orthonormal directions outside the basis: those of `fresh`, and random ones for what it no longer holds."""
    out = basis
    size = np.linalg.norm(fresh, axis=0)
    columns = [fresh[:, i] / size[i] for i in range(fresh.shape[1]) if size[i] > 0]
    while out.shape[1] < basis.shape[1] + most:
        v = columns.pop(0) if columns else rng.standard_normal(len(basis))
        before = np.linalg.norm(v)
        for _ in range(3):  # full reorthogonalisation
            v = v - out @ (out.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-8 * before:  # else a breakdown: nothing new in this direction
            v = v / left
            v = v - out @ (out.T @ v)
            out = np.hstack([out, (v / np.linalg.norm(v))[:, None]])
    return out[:, basis.shape[1] :]


def projected(rows: DataFrame, dims: int, n: int, sums: list[int], mean: np.ndarray, to: np.ndarray) -> DataFrame:
    """vec_id, deviation, w of rows(vec_id, x): exact deviations and whitened coordinates."""
    top = max(map(abs, sums), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(sums, dtype=object)
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), dtype=np.int64).reshape(-1, dims)
            most = n * int(np.abs(x).max(initial=0)) + top
            if most < 2**62:
                gap = n * x - s.astype(np.int64)
                narrow = int(np.abs(gap).max(initial=0)) ** 2 * dims < 2**62
                deviation = ((gap if narrow else gap.astype(object)) ** 2).sum(1)
            else:
                deviation = ((n * x.astype(object) - s) ** 2).sum(1)
            fits = [int(v) if v < 2**63 else None for v in deviation]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fits, pa.int64()), lists((x - mean) @ to, pa.float64())], names=["vec_id", "deviation", "w"])

    return rows.mapInArrow(run, "vec_id long, deviation long, w array<double>")


def whiten_one(rows: DataFrame, dims: int, n: int, wanted: int) -> DataFrame | None:
    """The whitened rows of one fit list rows(vec_id, x) of n vectors of one length; None where nothing varies."""
    xs = rows.select("x")
    sums = exact_sums(rows, dims)
    mean = np.array([float(Fraction(s, n)) for s in sums])

    def apply(v: np.ndarray) -> np.ndarray:
        return added(xs, dims, v.size, lambda x: (x - mean).T @ ((x - mean) @ v)).reshape(v.shape) / n

    values, vectors, _ = lanczos(apply, dims, min(wanted, dims))
    keep = values > dims * ROUNDING * max(values[0], 0.0)
    if not keep.any():
        return None
    values, vectors = values[keep], vectors[:, keep]
    done = save(projected(rows, dims, n, sums, mean, vectors / np.sqrt(values)), "whitened")
    total, lost = done.agg(F.sum(F.col("deviation").cast("decimal(38,0)")), F.count(F.when(F.col("deviation").isNull(), 1))).first()
    if lost:  # deviations beyond a long: their sum comes from the centred rows
        total = Fraction(added(xs, dims, 1, lambda x: ((x - mean) ** 2).sum(keepdims=True)[:, 0])[0]) * n * n
    trace = float(Fraction(total or 0) / n**3)
    k = len(values)
    centre = added(done.select("w"), k, k, lambda w: w.sum(0)) / n
    spread = added(done.select("w"), k, k * k, lambda w: (w - centre).T @ (w - centre)).reshape(k, k) / n
    error = float(np.abs(spread - np.eye(k)).max(initial=0))
    shares = F.array(*(F.lit(float(e / trace)) for e in values))
    out = done.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row of vectors(vec_id, embedding).

    Rows whose vector is null or holds null or non-finite components are left out; zero vectors take part. Vectors of
    each length are fitted and whitened among themselves. A component whose eigenvalue is nothing but rounding (rank
    below `components`, equal vectors, one row) has no whitened form and gives no rows; empty vectors and empty tables
    give none. A null vec_id stays null, repeated ids and rows count each for themselves, further columns are not read.
    A deviation beyond a long is null.
    """
    x = vectors.where(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("x"))
    rows = save(x.withColumn("dims", F.size("x")), "integers")
    lengths = rows.groupBy("dims").count().where("dims > 0").collect()  # one row a vector length
    parts = [whiten_one(rows.where(F.col("dims") == r["dims"]).select("vec_id", "x"), r["dims"], r["count"], components) for r in sorted(lengths)]
    discard(rows)
    parts = [p for p in parts if p is not None]
    if not parts:
        return vectors.sparkSession.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, parts)
