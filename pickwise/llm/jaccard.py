"""N-gram Jaccard join by count-vector R-trees.

1. Each text becomes its set of word shingles; equal sets are one node from here on. A set is also a point: its shingles
   are hashed into groups and counted (`rtree`). Two points' summed coordinate minima bound the shingles they share.
2. First round, for the bulk of the copies: nodes are sorted by four minimum hashes, and each is paired with the one
   before it of the same minimum. Pairs that pass the bound are verified, and their components found.
3. Second round, for all the rest: nodes that can link share a shingle among the first few of each in one order of all
   shingles (rare ones first, by counts over all documents). A shingle's nodes are a block. A small block gives its pairs,
   a larger one is an R-tree over the points, joined with itself under the bound; only pairs of nodes not yet in one
   component are looked at, and of those that pass the bound over finer groups each node's best one is verified: copies
   of one text are mostly most alike to that text.
4. Third round: the same blocks with the components of now, and all their pairs between components that pass the bounds.

After the third round no link between components is left, so the components are exact, while a group of thousands of
near copies gives a few pairs a member in place of all its pairs. Verification intersects whole sets of 64-bit shingle
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import rtree
from .common import bound_batches, discard, maybe_broadcast, save, slices
from .links import components, neighbours
from .shingles import shingle_set, shingle_sets

BUCKETS = 1 << 16
GROUPS = 64  # of the points in the R-tree
BLOCK = 2048  # members of a block that one task joins at a time
CHAIN = 4096  # nodes of one minimum hash that one task puts in order
BROADCAST = 200_000  # rows of two or three longs that a join may send to every executor
LEADS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def node_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def check_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 1)).astype(np.int64))


def sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, node, check, leads (minimum hashes) and fine (count vector) of every document; and, in rows of their own, each task's shingle counts by bucket."""
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "node": pa.int64(), "check": pa.int64(), "leads": pa.list_(pa.int64()), "fine": pa.binary(), "counts": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for lo, hi in slices(batch):
                part, out = batch.slice(lo, hi - lo), {k: [] for k in kinds if k not in ("doc_id", "counts")}
                for s in shingle_sets(part.column(1).to_pylist(), words):
                    fine = rtree.counts(s, rtree.groups_for(len(s)))
                    out["n"].append(len(s))
                    out["node"].append(node_of(s))
                    out["check"].append(check_of(s))
                    out["leads"].append(signed(np.array([(s * k).min() for k in LEADS], dtype=np.uint64)).tolist() if len(s) else [])
                    out["fine"].append(rtree.packed_fine(fine))
                    np.add.at(total, (s >> np.uint64(48)).astype(np.int64), 1)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, kinds[k]) for k, v in out.items()), pa.nulls(hi - lo, kinds["counts"])], schema=pa.schema(kinds))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], t) if k == "counts" else pa.nulls(1, t) for k, t in kinds.items()], schema=pa.schema(kinds))

    return docs.mapInArrow(run, "doc_id long, n long, node long, check long, leads array<long>, fine binary, counts array<long>")


def rarity(counted: DataFrame) -> np.ndarray:
    """The order's first key for each bucket of shingles: how many times the mean its count is, as a power of two."""
    by_bucket = counted.select(F.posexplode("counts").alias("bucket", "count")).groupBy("bucket").agg(F.sum("count").alias("count"))
    total = np.zeros(BUCKETS, dtype=np.int64)
    for r in by_bucket.where(F.col("count") > 0).collect():  # BUCKETS rows at most, whatever the table's size
        total[r["bucket"]] = r["count"]
    return np.clip(np.floor(np.log2(np.maximum(total / max(1.0, total.mean()), 1))), 0, 30).astype(np.uint8)


def postings(docs: DataFrame, words: int, percent: int, rare: np.ndarray) -> DataFrame:
    """token, node, n, short for the first shingles of each set: the larger set of a pair shares one of its first
    n - percent * n / 100 + 1 with the smaller one's `short` first n - 2 * percent * n / (100 + percent) + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi in slices(batch):
                tokens, nodes, ns, short = [], [], [], []
                for s in shingle_sets(batch.column(0).slice(lo, hi - lo).to_pylist(), words):
                    n = len(s)
                    if not n or (node := node_of(s)) in seen:  # the same set in this task: its postings are out already
                        continue
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(node)
                    key = (rare[s >> np.uint64(48)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
                    p, q = n + (-percent * n // 100) + 1, n + (-2 * percent * n // (100 + percent)) + 1
                    pick = np.argpartition(key, p - 1)[:p]
                    pick = pick[np.argsort(key[pick], kind="stable")]
                    tokens.append(s[pick])
                    nodes.append(np.full(p, node, dtype=np.int64))
                    ns.append(np.full(p, n, dtype=np.int32))
                    short.append(np.arange(p) < q)
                if tokens:
                    yield pa.RecordBatch.from_pydict({"token": pa.array(signed(np.concatenate(tokens))), "node": pa.array(np.concatenate(nodes)), "n": pa.array(np.concatenate(ns)), "short": pa.array(np.concatenate(short))})

    return docs.select("text").mapInArrow(run, "token long, node long, n int, short boolean")


def hash_sets(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """node, hashes: the whole sets of the nodes in `wanted`(doc_id, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch):
                part, nodes, hashes = batch.slice(lo, hi - lo), [], []
                for node, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), words), strict=True):
                    if node_of(s) == node:
                        nodes.append(node)
                        hashes.append(s.tobytes())
                yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "hashes": pa.array(hashes, pa.binary())})

    j = docs.join(maybe_broadcast(wanted, wanted.count(), BROADCAST), "doc_id").select("node", "text")
    return j.mapInArrow(run, "node long, hashes binary")


def met(posted: DataFrame, percent: int) -> DataFrame:
    """Rows of blocks with two members or more, each once: of small blocks the pairs (node, other) that may link and are of
    different components; of larger ones the members (other null). Sorted rows stream by: no block is gathered."""
    kinds = pa.schema({"token": pa.int64(), "node": pa.int64(), "n": pa.int32(), "short": pa.bool_(), "component": pa.int64(), "other": pa.int64()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        large: int | None = None  # the token of a larger block whose first members went out
        done: set[tuple[int, int]] = set()

        def pairs(t: pa.Table, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
            node, n, short, comp = (t[k].to_numpy() for k in ("node", "n", "short", "component"))
            n = n.astype(np.int64)
            x, y = rtree.expand(lo, hi, lo, hi)
            k = x < y
            x, y = x[k], y[k]
            k = (100 * n[x] >= percent * n[y]) & (100 * n[y] >= percent * n[x]) & (comp[x] != comp[y])
            k &= np.where(n[x] < n[y], short[x], np.where(n[y] < n[x], short[y], short[x] | short[y]))
            a, b = np.minimum(node[x[k]], node[y[k]]), np.maximum(node[x[k]], node[y[k]])
            new = list(set(zip(a.tolist(), b.tolist(), strict=True)) - done)
            if len(done) > 50_000:
                done.clear()
            done.update(new)
            if new:
                m = len(new)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array([p[0] for p in new], pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.array([p[1] for p in new], pa.int64())], schema=kinds)

        def members(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if len(t):
                yield from t.append_column("other", pa.nulls(len(t), pa.int64())).cast(kinds).combine_chunks().to_batches()

        def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """Blocks of which no more rows come (but for the first, whose earlier rows may be out)."""
            if not len(t):
                return
            token = t["token"].to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
            lo, hi = edges[:-1], edges[1:]
            big = (hi - lo > rtree.LEAF) | (token[lo] == large if large is not None else False)
            small = ~big & (hi - lo > 1)
            if small.any():
                yield from pairs(t, lo[small], hi[small])
            if big.any():
                yield from members(t.filter(pa.array(np.repeat(big, hi - lo))))

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if rest is not None:
                t = pa.concat_tables([rest, t])
            token, node = t["token"].to_numpy(), t["node"].to_numpy()
            new = np.ones(len(token), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            t = t.filter(pa.array(new)).combine_chunks()
            token = token[new]
            last = int(np.searchsorted(token, token[-1]))
            yield from whole(t.slice(0, last))
            rest = t.slice(last)
            if len(rest) > rtree.LEAF or token[-1] == large:  # all but the last row, which tells a repeated one
                if len(rest) > 1:
                    large = int(token[-1])
                    yield from members(rest.slice(0, len(rest) - 1))
                    rest = rest.slice(len(rest) - 1)
            else:
                large = None
        if rest is not None:
            yield from whole(rest)

    ordered = posted.select("token", "node", "n", "short", "component").repartition("token").sortWithinPartitions("token", "node")
    return ordered.mapInArrow(run, "token long, node long, n int, short boolean, component long, other long")


def blocks_of(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members, with their fine count vectors, of larger blocks that hold several components; a block in one task, or one over BLOCK
    members cut into parts, with each pair of parts a block of its own."""
    state = members.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("short").alias("any"))
    p = members.join(state.where((F.col("lo") != F.col("hi")) & F.col("any")).select("token", "members"), "token")
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    p = p.withColumn("own", F.when(parts > 1, F.pmod(F.xxhash64("node"), parts)).otherwise(0).cast("int"))
    p = p.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    p = p.select("token", (lo.cast("long") * 2**31 + hi).alias("part"), F.when(lo != hi, F.col("own") == hi).otherwise(False).cast("int").alias("side"), "node", "n", "short", "component")
    j = p.join(classes.select("node", "fine"), "node")
    return j.repartition("token", "part").sortWithinPartitions("token", "part", "n", "node")


def candidates(blocks: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs a < b of nodes of different components that the R-tree join of their block lets through and that pass the
    bound over finer groups; with `best`, of these only each node's with the partner that it can be most alike.

    blocks: token, part, side, node, n, short, component, fine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        done: set[tuple[int, int]] = set()

        def block(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            node, n, comp, side = t["node"].to_numpy(), t["n"].to_numpy().astype(np.int64), t["component"].to_numpy(), t["side"].to_numpy()
            short = t["short"].to_numpy()
            if (comp == comp[0]).all():
                return
            fine = t["fine"].to_pylist()
            points = np.stack([rtree.fold(rtree.unpacked(f), GROUPS).astype(np.int32) for f in fine])
            top, partner = np.zeros(len(t)), np.full(len(t), -1)
            for x, y in rtree.join(points, n, percent):
                k = np.where(n[x] < n[y], short[x], np.where(n[y] < n[x], short[y], short[x] | short[y])) & (comp[x] != comp[y])
                if side.any():  # two parts of a large block: pairs inside a part belong to another task
                    k &= side[x] != side[y]
                x, y = x[k], y[k]
                most = rtree.close(fine, n, x, y, percent)
                x, y, most = x[most >= 0], y[most >= 0], most[most >= 0]
                if best:
                    alike = most / (n[x] + n[y] - most)
                    for i, j in ((x, y), (y, x)):
                        order = np.lexsort((node[j], -alike, i))
                        order = order[np.diff(i[order], prepend=-1) > 0]
                        order = order[alike[order] > top[i[order]]]
                        top[i[order]], partner[i[order]] = alike[order], j[order]
                    continue
                yield from put(node[x], node[y])
            x = np.flatnonzero(partner >= 0)
            yield from put(node[x], node[partner[x]])

        def put(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(x):
                new = list(set(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True)) - done)
                if len(done) > 50_000:
                    done.clear()
                done.update(new)
                if new:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in new], pa.int64()), "b": pa.array([p[1] for p in new], pa.int64())})

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if rest is not None:
                t = pa.concat_tables([rest, t])
            token, part = t["token"].to_numpy(), t["part"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1])) + 1]).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield from block(t.slice(a, b - a))
            rest = t.slice(edges[-1])
        if rest is not None and len(rest):
            yield from block(rest)

    return blocks.mapInArrow(run, "a long, b long")


def bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the bound over about as many groups as the sets have shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([rtree.fits(*r, percent) for r in rows], pa.bool_()))

    c = classes.select("node", "n", "fine")
    j = pairs.join(c.withColumnsRenamed({"node": "a", "n": "na", "fine": "fa"}), "a").join(c.withColumnsRenamed({"node": "b", "n": "nb", "fine": "fb"}), "b")
    near = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    return j.where(near).select("a", "b", "na", "nb", "fa", "fb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int, firsts: DataFrame) -> DataFrame:
    """The pairs whose whole sets have at least that Jaccard similarity; sets are made anew from the texts of the pairs' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                i = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * i >= percent * (len(x) + len(y) - i))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    h = save(hash_sets(docs, words, firsts.join(ends, "node").select("doc_id", "node").distinct()).dropDuplicates(["node"]), "hashes")
    j = pairs.join(h.withColumnsRenamed({"node": "a", "hashes": "x"}), "a").join(h.withColumnsRenamed({"node": "b", "hashes": "y"}), "b")
    out = save(j.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    discard(h)
    return out


def linked(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, node, check of every row of docs(doc_id, text); and of every class of equal sets its smallest doc_id, its copies and its component."""
    every = save(sets(docs, words), "sets")
    rare = rarity(every.where(F.col("counts").isNotNull()))
    rows = every.where(F.col("counts").isNull()).select("doc_id", "n", "node", "check")
    named = every.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    firsts = save(named.groupBy("node", "check").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("n", "leads", "fine"))), "classes")
    leads = firsts.select("node", "n", F.posexplode("leads").alias("k", "lead"))
    near = save(bounded(neighbours(leads, ["k", "lead"], ["n", "node"], CHAIN), firsts, percent), "pairs")
    links = verified(near, docs, words, percent, firsts)
    joined = components(links)
    posted = postings(docs.where(F.col("doc_id").isNotNull()), words, percent, rare)
    posted = posted.join(maybe_broadcast(joined, joined.count(), BROADCAST), "node", "left").withColumn("component", F.coalesce("component", "node"))
    blocks = save(met(posted, percent), "blocks")
    pairs = blocks.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b"))
    members = blocks.where(F.col("other").isNull()).select("token", "node", "n", "short", "component")
    more = save(bounded(pairs.union(candidates(blocks_of(members, firsts), percent, True)).distinct(), firsts, percent), "pairs")
    found = verified(more, docs, words, percent, firsts)
    discard(near, joined)
    joined = components(links.union(found))
    discard(more)
    placed = members.drop("component").join(maybe_broadcast(joined, joined.count(), BROADCAST), "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = save(bounded(candidates(blocks_of(placed, firsts), percent, False).distinct(), firsts, percent), "pairs")
    rest = verified(more, docs, words, percent, firsts)
    discard(blocks, joined)
    joined = components(links.union(found).union(rest))
    discard(more, links, found, rest)
    return rows, firsts.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def similar(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    Texts with equal sets link; texts without words have 0 shingles and link with nothing. A null doc_id stays null, and
    its row neither names a component nor joins one. Rows that repeat, or share a doc_id, are documents like others:
    component_id is the smallest doc_id reachable. An empty table gives an empty result; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows, inside = linked(plain(docs), words, percent)
    known = inside.withColumns({"component_id": F.min("doc_id").over(Window.partitionBy("component"))})
    known = save(known.where((F.col("copies") > 1) | (F.col("component_id") != F.col("doc_id"))).select(F.col("node").alias("kn"), F.col("check").alias("kc"), F.col("component_id").alias("kid")), "known")
    out = rows.join(maybe_broadcast(known, known.count(), BROADCAST), (F.col("node") == F.col("kn")) & (F.col("check") == F.col("kc")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("kid", "doc_id").alias("component_id"))


def keyed(docs: DataFrame, words: int) -> DataFrame:
    """docs with _n, _node and _check, the size and the key of each text's set."""

    @pandas_udf("n long, node long, check long")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [(len(s), node_of(s), check_of(s)) for s in (shingle_set(t, words) for t in texts)]
        return pd.DataFrame(found, columns=["n", "node", "check"], dtype="int64")

    key = docs.withColumn("_key", run(F.col("text").cast("binary")))
    return key.withColumns({"_n": F.col("_key.n"), "_node": F.col("_key.node"), "_check": F.col("_key.check")}).drop("_key")


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of similar documents, with all its columns: that with the smallest doc_id, then set key, then text.

    Rows that link with nothing stay, whether or not they share a doc_id with others; so do rows with null doc_id.
    """
    bound_batches(docs.sparkSession)
    rows, inside = linked(plain(docs), words, percent)
    rows = rows.where(F.col("doc_id").isNotNull())
    best = save(inside.groupBy("component").agg(F.min(F.struct("doc_id", "node", "check")).alias("k")).select("k.*"), "kept")
    twice = save(rows.groupBy("doc_id").count().where(F.col("count") > 1).select(F.col("doc_id").alias("_id")), "repeated")
    n_twice = twice.count()
    own = docs.withColumn("_id", F.col("doc_id").cast("long"))
    none = own.where(F.col("_id").isNull()).select(*docs.columns)
    ids = best.select("doc_id").union(rows.where(F.col("n") == 0).select("doc_id")).select(F.col("doc_id").alias("_id"))
    kept = own.join(ids.join(maybe_broadcast(twice, n_twice), "_id", "left_anti"), "_id", "left_semi").select(*docs.columns).unionByName(none)
    if not n_twice:
        return kept
    # Only rows that share a doc_id with others need their own set's key to tell which of them is kept.
    same = keyed(own.join(maybe_broadcast(twice, n_twice), "_id", "left_semi"), words)
    first = same.where(F.col("_n") > 0).join(best.withColumnsRenamed({"doc_id": "_id", "node": "_node", "check": "_check"}), ["_id", "_node", "_check"], "left_semi")
    order = ["text", *(c for c, t in docs.dtypes if c != "text" and "map<" not in t and "variant" not in t)]
    first = first.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_node", "_check").orderBy(*order))).where(F.col("_nth") == 1)
    return kept.unionByName(first.select(*docs.columns)).unionByName(same.where(F.col("_n") == 0).select(*docs.columns))
