"""Embedding near-copies by spherical-cap filters.

Filter directions form a structured random product code: the space is rotated at random and cut into two blocks, each
with a codebook of random unit vectors, and a filter is one code from each block. A vector lies in its nearest filter, at
the angle `a` say, and is list-decoded to all filters inside its own cap: those that a vector at the link's angle `d` from
it could lie in, at an angle of `a` or less. So of two linked vectors, that with the larger angle finds the other in the
other's nearest filter. The cap's bound is  cos a cos d - m sin a sin d;  with m = 1 it is cos(a + d) and nothing is
lost. The codes are random, so the worst case needs a direction that random codes hardly ever take: m is `confidence`
standard deviations of a random direction's cosine (never over 1), and each of several codes with rotations of their own
misses a link with the chance of one normal variable beyond `confidence` (0.0013 at 3; both of two codes: 2e-6).

Vectors that share a filter meet in bounded square blocks as one-byte codes, whose error is bounded by their residuals;
pairs that the bound leaves are verified on whole vectors in double precision.

So that no group of copies gives all its pairs, there are two rounds: first each vector with the one before it among those
of the same nearest filters; then, with those links' components known, pairs of a filter that are not yet in one
component. All links of a vector lie inside its component, and are counted there in square blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, discard, maybe_broadcast, save
from .links import components, neighbours
from .vectors import matrix, usable

CHAIN = 4096  # vectors of the same nearest filters that one task puts in order
BROADCAST = 200_000  # rows of two longs that a join may send to every executor


@dataclass
class ProductCode:
    rotation: np.ndarray
    books: list[np.ndarray]  # of each block: codes x block dimensions, of length sqrt(1 / blocks)

    @classmethod
    def draw(cls, dims: int, codes: int, seed: int = 11) -> "ProductCode":
        rng = np.random.default_rng(seed)
        rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        books = []
        for part in np.array_split(np.arange(dims), min(2, dims)):
            c = rng.standard_normal((codes, len(part)))
            books.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(min(2, dims)))
        return cls(rotation, books)

    def decode(self, x: np.ndarray, link: float, confidence: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """The nearest filter of each unit vector, and all filters inside its cap (the nearest among them)."""
        parts = np.split(x @ self.rotation, np.cumsum([b.shape[1] for b in self.books])[:-1], axis=1)
        sums = [p @ b.T for p, b in zip(parts, self.books, strict=True)]
        n = len(self.books[0])
        best = np.minimum(sum(s.max(axis=1) for s in sums), 1)
        m = min(1.0, confidence / np.sqrt(max(1, x.shape[1] - 1)))
        bound = best * link - m * np.sqrt(1 - best**2) * np.sqrt(1 - link**2) - 1e-9
        if len(sums) == 1:
            return sums[0].argmax(axis=1), [np.flatnonzero(s >= t) for s, t in zip(sums[0], bound, strict=True)]
        nearest = sums[0].argmax(axis=1) * n + sums[1].argmax(axis=1)
        found = []
        for a, b, t in zip(*sums, bound, strict=True):
            order = np.argsort(-b)
            i = np.flatnonzero(a >= t - b[order[0]])
            many = np.searchsorted(-b[order], a[i] - t, side="right")  # codes of the second block that reach the bound with i
            j = order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            found.append(np.repeat(i, many) * n + j)
        return nearest, found


@lru_cache(maxsize=8)
def drawn(dims: int, size: int, codes: int) -> list[ProductCode]:
    return [ProductCode.draw(dims, size, seed) for seed in range(11, 11 + codes)]


def placed(classes: DataFrame, kind: str, size: int, codes: int, link: float, confidence: float) -> DataFrame:
    """node, label, dims, unit (doubles), small (one-byte codes), scale, error, own (nearest filters) and filters of classes(node, label, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            for d in np.unique(lengths).tolist():
                of_length = batch.filter(pa.array(lengths == d))
                for lo in range(0, of_length.num_rows, 512):
                    part = of_length.slice(lo, 512)
                    x = matrix(part.column(2), d)
                    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that no square is lost or infinite
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    scale = np.abs(x).max(axis=1) / 127
                    small = np.rint(x / scale[:, None]).astype(np.int8)
                    error = np.linalg.norm(x - small * scale[:, None], axis=1)
                    decoded = [c.decode(x, link, confidence) for c in drawn(d, size, codes)]
                    own = np.stack([o * codes + k for k, (o, _) in enumerate(decoded)], axis=1)
                    filters = [np.concatenate([f[i] * codes + k for k, (_, f) in enumerate(decoded)]) for i in range(len(x))]
                    yield pa.RecordBatch.from_pydict({
                        "node": part.column(0), "label": part.column(1), "dims": pa.array(np.full(len(x), d, dtype=np.int32)), "unit": pa.array([v.tobytes() for v in x], pa.binary()),
                        "small": pa.array([v.tobytes() for v in small], pa.binary()), "scale": pa.array(scale), "error": pa.array(error), "own": pa.array(own.tolist(), pa.list_(pa.int64())), "filters": pa.array(filters, pa.list_(pa.int64())),
                    })

    return classes.select("node", "label", "embedding").mapInArrow(run, f"node long, label {kind}, dims int, unit binary, small binary, scale double, error double, own array<long>, filters array<long>")


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, of vectors of length 1; what decides a link wherever one is decided."""
    return (x * y).sum(axis=1)


def verified(pairs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """The pairs of equal label and length whose cosine reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, dtype=bool)
            d = batch.column(2).to_numpy()
            for k in np.unique(d).tolist():
                at = np.flatnonzero(d == k)
                x, y = (np.frombuffer(b"".join(batch.column(c).take(pa.array(at)).to_pylist())).reshape(-1, k) for c in (3, 4))
                near[at] = cosines(x, y) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(near))

    of = units.select("node", "label", "dims", "unit")
    j = pairs.distinct().join(of.withColumnsRenamed({"node": "a", "label": "la", "dims": "da", "unit": "ua"}), "a").join(of.withColumnsRenamed({"node": "b", "label": "lb", "dims": "db", "unit": "ub"}), "b")
    return j.where((F.col("la") == F.col("lb")) & (F.col("da") == F.col("db"))).select("a", "b", "da", "ua", "ub").mapInArrow(run, "a long, b long")


def squares(rows: DataFrame, block_rows: int) -> DataFrame:
    """rows(key, members, node, ...) cut into parts of about block_rows; each pair of parts of a key becomes a block (key, i, j) in
    one task, a row of which knows its own part by `second` (whether it is of part j, in blocks of two parts)."""
    parts = F.ceil(F.col("members") / block_rows).cast("int")
    r = rows.withColumn("mine", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    i, j = F.least("mine", "other"), F.greatest("mine", "other")
    r = r.withColumns({"i": i, "j": j, "second": (i != j) & (F.col("mine") == j)}).drop("mine", "other", "members")
    return r.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows of one (key, i, j) after another."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        key, i, j = (t[c].to_numpy() for c in ("key", "i", "j"))
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield t.slice(lo, hi - lo)
        rest = t.slice(edges[-1])
    if rest is not None and len(rest):
        yield rest


def joining(near: np.ndarray, sure: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of possible links, those that have to be looked at: of the sure ones as many as join what they join, and all others
    between what these leave apart. So a group of n copies gives n - 1 pairs."""
    label = np.unique(component, return_inverse=True)[1]
    x, y = [], []
    for i in np.flatnonzero(sure.any(axis=1)).tolist():
        for j in np.flatnonzero(sure[i] & (label != label[i])).tolist():
            if label[i] != label[j]:
                x.append(i)
                y.append(j)
                label[label == label[j]] = label[i]
    i, j = np.nonzero(near & ~sure & (label[:, None] != label[None]))
    keep = i < j
    return np.concatenate([np.array(x, dtype=np.int64), i[keep]]), np.concatenate([np.array(y, dtype=np.int64), j[keep]])


def met(in_filter: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """Pairs of different components that share a filter, the nearest of one of them, and whose one-byte codes leave the link open.

    in_filter: key, node, component, own, small, scale, error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            if len(t) < 2:
                continue
            node, comp, own, scale, error, second = (t[c].to_numpy() for c in ("node", "component", "own", "scale", "error", "second"))
            small = t["small"].to_pylist()
            lengths = np.array([len(s) for s in small])
            for d in np.unique(lengths).tolist():  # one length a filter, but for keys that collide
                at = np.flatnonzero(lengths == d)
                q = np.frombuffer(b"".join(small[k] for k in at), dtype=np.int8).reshape(-1, d).astype(np.float64)
                near, sure = np.zeros((len(at), len(at)), dtype=bool), np.zeros((len(at), len(at)), dtype=bool)
                for lo in range(0, len(at), 256):
                    x = at[lo : lo + 256]
                    sims, slack = (q[lo : lo + 256] @ q.T) * scale[x][:, None] * scale[at][None], error[x][:, None] + error[at][None] + np.outer(error[x], error[at])
                    open_ = (comp[x][:, None] != comp[at][None]) & (own[x][:, None] | own[at][None])
                    if second.any():  # of two parts, pairs inside a part belong to another task
                        open_ &= second[x][:, None] != second[at][None]
                    near[lo : lo + 256] = open_ & (sims + slack >= threshold - 1e-9)
                    sure[lo : lo + 256] = open_ & (sims - slack >= threshold + 1e-9)
                if near.any():
                    i, j = joining(near, sure, comp[at])
                    i, j = node[at[i]], node[at[j]]
                    yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(i, j)), "b": pa.array(np.maximum(i, j))})

    state = in_filter.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("own").alias("any"))
    open_ = in_filter.join(state.where((F.col("lo") != F.col("hi")) & F.col("any")).select("key", "members"), "key")
    return squares(open_, block_rows).mapInArrow(run, "a long, b long")


def near_copies(embeddings: DataFrame, threshold: float = 0.98, confidence: float = 3.0, codes: int = 2, occupancy: int = 16, block_rows: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings(vec_id, embedding, label).

    Only vectors of one label and one length are compared. Rows with a null vec_id or label, and null, zero or unfinished
    vectors, link with nothing: n_links 0, their own vec_id as component. Vectors of any scale, very small or large, are
    brought to length 1 first. Rows with equal vectors link with each other whether their vec_ids repeat or not, and are
    compared with the rest as one. An empty table gives an empty result. Other columns are not read.

    A filter holds about `occupancy` nearest vectors of the largest label. Search is exact but for the chance that
    `confidence` and `codes` leave (see above).
    """
    bound_batches(embeddings.sparkSession)
    vec = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vec.alias("embedding"))
    ok = usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    keyed = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    keyed = keyed.withColumns({"k1": F.when(F.col("ok"), F.xxhash64("label", "embedding")), "k2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "embedding", "label"))})
    classes = keyed.where("ok").groupBy("k1", "k2", "label").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    classes = save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    most = classes.groupBy("label", F.size("embedding")).count().agg(F.max("count")).first()[0] or 0
    size = max(4, int(np.ceil(np.sqrt(most / occupancy))))
    units = save(placed(classes, dict(rows.dtypes)["label"], size, codes, threshold, confidence), "units")
    own = [F.element_at("own", k + 1) for k in range(codes)]
    pairs = neighbours(units.select("node", "label", "dims", *(o.alias(f"own{k}") for k, o in enumerate(own))), ["label", "dims", *(f"own{k}" for k in range(codes))], ["node"], CHAIN)
    links = save(verified(pairs, units, threshold), "found")
    joined = components(links)
    where = units.join(maybe_broadcast(joined, joined.count(), BROADCAST), "node", "left").withColumn("component", F.coalesce("component", "node"))
    where = where.select("label", "dims", "node", "component", "own", "small", "scale", "error", F.explode("filters").alias("filter"))
    where = where.select(F.xxhash64("label", "dims", "filter").alias("key"), "node", "component", F.array_contains("own", F.col("filter")).alias("own"), "small", "scale", "error")
    more = save(verified(met(where, threshold, block_rows), units, threshold), "found")
    discard(joined)
    joined = components(links.union(more))
    discard(links, more)
    members = joined.join(units.select("node", "unit"), "node").join(classes.select("node", "copies", "first_id"), "node")
    counted = links_inside(members, threshold, block_rows)
    first_id = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = classes.join(joined, "node", "left").join(first_id, "component", "left").join(counted, "node", "left")
    known = known.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    out = keyed.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def links_inside(members: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """node, links: how many rows of other classes of members(node, component, unit, copies) in its component each class links with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            node, copies, second = (t[c].to_numpy() for c in ("node", "copies", "second"))
            unit = t["unit"].to_pylist()
            x = np.frombuffer(b"".join(unit)).reshape(len(unit), -1)
            a, b = (np.flatnonzero(~second), np.flatnonzero(second)) if second.any() else (np.arange(len(x)),) * 2
            links = np.zeros(len(x), dtype=np.int64)
            for lo in range(0, len(a), 256):
                sims = x[a[lo : lo + 256]] @ x[b].T
                near = sims >= threshold
                i, j = np.nonzero(np.abs(sims - threshold) < 1e-12)  # where the product's order of adding may decide
                near[i, j] = cosines(x[a[lo + i]], x[b[j]]) >= threshold
                near &= a[lo : lo + 256][:, None] != b[None]
                links[a[lo : lo + 256]] += near @ copies[b]
                if second.any():
                    links[b] += near.T @ copies[a[lo : lo + 256]]
            yield pa.RecordBatch.from_pydict({"node": pa.array(node), "links": pa.array(links)})

    rows = members.select(F.col("component").alias("key"), "node", "unit", "copies").join(members.groupBy(F.col("component").alias("key")).agg(F.count(F.lit(1)).alias("members")), "key")
    return squares(rows, block_rows).mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
