"""Removal of strings that repeat anywhere in the corpus, by sorted suffixes.

1. Every string of `length` bytes belongs to its minimizer: the least hash among its GRAM-byte substrings. Strings that
   follow each other and share a minimizer form a run. Equal strings have equal minimizers, so they meet in one group,
   wherever they stand; runs whose minimizer occurs nowhere else hold nothing that repeats.
2. Runs of equal bytes are one content with a count, so thousands of copies of a passage are one row.
3. Each content's bytes go, once, to the task of its group. There the suffixes that start in all contents are put in order
   (`suffixes`), and a string repeats where its suffix shares `length` bytes with a neighbour, or its content has copies.
4. The repeated starts go back to the documents, which lose the bytes that they cover.

A group of more than CONTENTS different contents (a short line that stands in a third of all documents, in other company
each time) is dealt anew by whole strings: their hash is the group, so only strings that occur twice go on.

Texts are told apart by 128 bits of SHA-256, runs of one group by 64 bits of a hash of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, maybe_broadcast, save, slices
from .suffixes import ordered

GRAM = 32
RUN = 512  # most starts in a run
CONTENTS = 4000  # most contents in a group that one task puts in order
SIDE = 50_000  # bytes of short texts that are worked on side by side
ROOM = 3_000_000  # bytes of text that a task puts in order at once
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position: of eight bytes as one number, then by doubling."""
    n = len(text) // 8 + 1
    wide = np.concatenate([text, np.zeros(8 * n + 8 - len(text), dtype=np.uint8)])
    h, step = np.empty((n, 8), dtype=np.uint64), 8
    for i in range(8):
        h[:, i] = wide[i : i + 8 * n].view("<u8")
    h = (h.ravel()[: len(text) - 7] + np.uint64(1)) * _A
    h ^= h >> np.uint64(32)
    while step < GRAM:
        right = h[step:] >> np.uint64(31)
        right += h[step:]
        h = h[:-step] * _B
        h ^= right
        h *= _C
        h ^= h >> np.uint64(29)
        step *= 2
    return h


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, minimizer, first start and number of starts of each run of the texts, by text and start, and the minimizers of
    runs that may repeat within themselves; nothing for texts under `length` bytes. Short texts are worked on side by side.
    """
    long = [i for i, t in enumerate(texts) if len(t) >= length]
    sizes, out, lo = np.array([len(texts[i]) for i in long], dtype=np.int64), [], 0
    ends = np.cumsum(sizes)
    while lo < len(long):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + SIDE, side="right")))
        own, *found = runs_of([texts[i] for i in long[lo:hi]], length)
        out.append((np.array(long[lo:hi])[own], *found))
        lo = hi
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none.view(np.uint64), none, none, none.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def runs_of(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of texts that all have `length` bytes, as one array: windows over two texts are left out.

    A run whose first minimizer leaves while the run goes on holds a second one; no other run has two equal strings.
    """
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    stop = begin + sizes - length + 1  # behind each text's last start
    grams = gram_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8))
    least, width, step = grams, length - GRAM + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    new = np.ones(len(least), dtype=bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[begin] = new[stop[:-1]] = True
    leaves = np.flatnonzero(~new[1:] & (grams[: len(least) - 1] == least[:-1]))
    periodic = least[leaves[leaves < stop[np.searchsorted(begin, leaves, side="right") - 1]]]
    edges = np.flatnonzero(new)
    size = np.diff(np.append(edges, len(least)))
    own = np.searchsorted(begin, edges, side="right") - 1
    inside = edges < stop[own]
    edges, size, own = edges[inside], size[inside], own[inside]
    parts = -(-size // RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    edges, size, own = np.repeat(edges, parts), np.repeat(size, parts), np.repeat(own, parts)
    return own, least[edges], edges + RUN * nth - begin[own], np.minimum(size - RUN * nth, RUN), periodic


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def minimizers(texts: DataFrame, length: int) -> DataFrame:
    """mh, seen: the minimizers of all runs, counted within each task's slices; more than once where a run may repeat within itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch):
                _, mh, _, _, periodic = runs([t for t in batch.column(0).slice(lo, hi - lo).to_pylist() if t], length)
                if len(mh):
                    mh, seen = np.unique(np.concatenate([mh, periodic]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([as_long(mh), pa.array(seen)], names=["mh", "seen"])

    return texts.select("text").mapInArrow(run, "mh long, seen long")


def cells(texts: DataFrame, length: int) -> DataFrame:
    """mh, ch, key, at, size of every run: its group, its content's hash, its text, its first start and its starts."""
    names = ["mh", "ch", "key", "at", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch):
                part = batch.slice(lo, hi - lo)
                texts = [t or b"" for t in part.column(1).to_pylist()]
                own, mh, at, size, _ = runs(texts, length)
                if len(own):
                    ch = [xxhash.xxh3_64_intdigest(texts[i][a:b]) for i, a, b in zip(own.tolist(), at.tolist(), (at + size + length - 1).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([as_long(mh), as_long(np.array(ch, dtype=np.uint64)), part.column(0).take(pa.array(own)), pa.array(at), pa.array(size.astype(np.int32))], names=names)

    return texts.select("key", "text").mapInArrow(run, "mh long, ch long, key binary, at long, size int")


def single_strings(texts: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """The runs of hot(key, at, size), cut into single strings: mh and ch are the string's own hash."""
    wanted = hot.groupBy("key").agg(F.collect_list(F.struct("at", "size")).alias("runs"))
    names = ["mh", "ch", "key", "at", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at = [a for r in found for a in range(r["at"], r["at"] + r["size"])]
                h = as_long(np.array([xxhash.xxh3_64_intdigest(text[a : a + length]) for a in at], dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([h, h, pa.array([key] * len(at), pa.binary()), pa.array(at, pa.int64()), pa.array([1] * len(at), pa.int32())], names=names)

    return texts.select("key", "text").join(wanted, "key").mapInArrow(run, "mh long, ch long, key binary, at long, size int")


def contents(classes: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """mh, ch, size, copies, bytes of each content in wanted(mh, ch, size, copies, key, at), cut from its text in classes(key, text)."""
    by_text = wanted.groupBy("key").agg(F.collect_list(F.struct("mh", "ch", "size", "copies", "at")).alias("runs"))
    kinds = pa.schema({"mh": pa.int64(), "ch": pa.int64(), "size": pa.int32(), "copies": pa.int64(), "bytes": pa.binary()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in found], kinds.field(k).type) for k in kinds.names[:4]), pa.array([text[r["at"] : r["at"] + r["size"] + length - 1] for r in found], pa.binary())], schema=kinds)

    return classes.join(by_text, "key").select("text", "runs").mapInArrow(run, "mh long, ch long, size int, copies long, bytes binary")


def settle(rows: list[tuple], length: int) -> pa.RecordBatch:
    """The repeated starts of whole groups' rows (mh, ch, size, copies, bytes). A group in which every content has copies needs no order: all its strings repeat."""
    kinds = pa.schema({"mh": pa.int64(), "ch": pa.int64(), "size": pa.int32(), "lo": pa.list_(pa.int32()), "hi": pa.list_(pa.int32())})
    size, copies = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    nth = np.cumsum(size) - size
    mh = np.array([r[0] for r in rows])
    heads = np.flatnonzero(np.append(True, mh[1:] != mh[:-1]))
    open_ = np.repeat(np.minimum.reduceat(copies, heads) < 2, np.diff(np.append(heads, len(rows))))  # groups whose order tells more than the copies
    text = np.frombuffer(b"".join(r[4] for r, o in zip(rows, open_.tolist(), strict=True) if o), dtype=np.uint8)
    whole = np.where(open_, size + length - 1, 0)
    starts = np.repeat(np.cumsum(whole) - whole - nth, size) + np.arange(size.sum())
    sorted_ = np.flatnonzero(np.repeat(open_, size))
    order, shared = ordered(text, starts[sorted_], length)
    twice = np.append(shared, 0) >= length
    marked = np.append(np.repeat(copies > 1, size), False)
    marked[sorted_[order]] |= twice[:-1] | twice[1:]
    own = np.repeat(np.arange(len(rows)), size)
    start = np.flatnonzero(marked[:-1] & ~np.concatenate([[False], marked[:-2] & (own[1:] == own[:-1])])) if len(own) else own
    end = np.flatnonzero(marked[:-1] & ~(marked[1:] & np.append(own[1:] == own[:-1], False))) + 1 if len(own) else own
    lo, hi = (start - nth[own[start]]).astype(np.int32), (end - nth[own[end - 1]]).astype(np.int32)
    cuts = pa.array(np.searchsorted(own[start], np.arange(len(rows) + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(size, pa.int32()), pa.ListArray.from_arrays(cuts, pa.array(lo)), pa.ListArray.from_arrays(cuts, pa.array(hi))], schema=kinds)


def repeated(found: DataFrame, length: int) -> DataFrame:
    """mh, ch, size, lo, hi: the starts lo <= start < hi of each content whose strings occur elsewhere too, by the order of all suffixes of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if room > ROOM and row[0] != held[-1][0]:
                    yield settle(held, length)
                    held, room = [], 0
                held.append(row)
                room += len(row[4])
        if held:
            yield settle(held, length)

    rows = found.select("mh", "ch", "size", "copies", "bytes").repartition("mh").sortWithinPartitions("mh", "ch")
    return rows.mapInArrow(run, "mh long, ch long, size int, lo array<int>, hi array<int>")


def text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def cut(classes: DataFrame, covered: DataFrame, length: int) -> DataFrame:
    """key, n_removed, spans, kept of each text that loses something: classes(key, text) without the bytes of covered(key, at, lo, hi)."""
    by_text = covered.groupBy("key").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("runs"))
    kinds = pa.schema({"key": pa.binary(), "n_removed": pa.int64(), "spans": pa.list_(pa.list_(pa.int64())), "kept": pa.binary()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                pairs = sorted((r["at"] + a, r["at"] + b - 1 + length) for r in found for a, b in zip(r["lo"], r["hi"], strict=True))
                spans = []
                for a, b in pairs:
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([len(text) - len(kept)]), pa.array([spans], kinds.field("spans").type), pa.array([kept], pa.binary())], schema=kinds)

    return classes.join(by_text, "key").select("key", "text", "runs").mapInArrow(run, "key binary, n_removed long, spans array<array<long>>, kept binary")


def trimmed(docs: DataFrame, length: int = 200) -> tuple[DataFrame, DataFrame]:
    """All rows of docs(doc_id, text) as (doc_id, key, text), text as bytes; and key, n_removed, spans, kept of the texts
    that lose bytes, kept as bytes: a cut may stand inside a character.

    spans are [from, to) in bytes, maximal, ascending. Null texts count as empty and, as all texts under `length` bytes,
    lose nothing. Rows that repeat, or share a doc_id, are documents like others, so texts that stand twice go altogether.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings of {2 * GRAM} bytes at least")
    bound_batches(docs.sparkSession)
    bytes_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    texts = bytes_.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    shared = minimizers(bytes_, length).groupBy("mh").agg(F.sum("seen").alias("seen")).where("seen > 1").select("mh")
    members = save(cells(texts, length).join(shared, "mh"), "runs")
    group = members.groupBy("mh", "ch", "size").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "at")).alias("first"))
    wanted = save(group.select("mh", "ch", "size", "copies", "first.*"), "contents")
    hot = save(wanted.groupBy("mh").count().where(F.col("count") > CONTENTS).select("mh"), "hot")
    made = [members, wanted, hot]
    if n_hot := hot.count():
        few = maybe_broadcast(hot, n_hot)
        single = save(single_strings(texts, members.join(few, "mh").select("key", "at", "size").distinct(), length), "strings")
        calm = wanted.join(few, "mh", "left_anti")
        twice = single.groupBy("mh", "ch", "size").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "at")).alias("first")).where("copies > 1")
        wanted = calm.unionByName(twice.select("mh", "ch", "size", "copies", "first.*"))
        members = members.join(few, "mh", "left_anti").unionByName(single)
        made.append(single)
    classes = texts.groupBy("key").agg(F.first("text").alias("text"))
    marked = repeated(contents(classes, wanted, length), length).where(F.size("lo") > 0)
    covered = members.join(marked, ["mh", "ch", "size"]).select("key", "at", "lo", "hi").distinct()
    done = save(cut(classes, covered, length), "trimmed")
    discard(*made)
    return texts, done


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept of every row of docs(doc_id, text): the text as bytes without any byte that
    a string of `length` bytes covers which also starts anywhere else. See `trimmed` for odd rows; other columns are not read."""
    texts, done = trimmed(docs, length)
    out = texts.join(done, "key", "left")
    return out.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_spans"), F.coalesce("kept", "text").alias("kept"))


def digest(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: the same result, its texts as SHA-256 in hex, with no text shuffled for it."""
    texts, done = trimmed(docs, length)
    own = texts.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    small = done.select("key", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("rest"))
    zero = F.lit(0).cast("long")
    return own.join(small, "key", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("rest", "whole").alias("kept_sha256"))
