"""Best-fit packing with large-item matching, on counts of lengths.

How pieces share sequences depends on their lengths alone, and a length is one of 1..capacity. So the plan is made from
a histogram of at most `capacity` numbers, whatever the size of the corpus, and then dealt out to the pieces by their
rank within their length:

1. Pieces above a third of the capacity are matched greedily, the longest first, each with the longest other large piece
   that still fits: at most two in a sequence.
2. Smaller pieces, the longest first, go to the fullest sequence that has room (best fit); a new sequence opens only
   when none has room.

A run of equal steps is taken at once (as many pieces as the rarer side has), so the plan has few rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, maybe_broadcast, save, slices
from .tokens import encoder

PLAN = "length int, rank_from long, rank_to long, sequence_from long, offset long"


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, sequence_from, offset): pieces rank_from..rank_to-1 of a length start at `offset` in sequences sequence_from, +1, ..."""
    left = {k: n for k, n in histogram.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a piece is longer than the capacity or empty")
    used: dict[int, int] = defaultdict(int)  # ranks given out of each length
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room -> [(first sequence, how many)]
    opened = 0

    def put(length: int, n: int, first: int, at: int) -> None:
        rows.append((length, used[length], used[length] + n, first, at))
        used[length] += n
        left[length] -= n

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for i, a in enumerate(large):
        while left[a]:
            b = next((k for k in large[i:] if left[k] and a + k <= capacity and (k != a or left[a] > 1)), None)
            if b is None:
                n = left[a]
                put(a, n, opened, 0)
                gaps[capacity - a].append((opened, n))
            else:
                n = left[a] // 2 if a == b else min(left[a], left[b])
                put(a, n, opened, 0)
                put(b, n, opened, a)
                gaps[capacity - a - b].append((opened, n))
            opened += n
    room = [g for g, x in gaps.items() if x]
    heapq.heapify(room)
    sizes = np.zeros(capacity + 1, dtype=np.int64)  # sequences by free room
    for g, x in gaps.items():
        sizes[g] = sum(n for _, n in x)
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            fit = np.flatnonzero(sizes[s:])
            if fit.size:
                g = int(fit[0]) + s
                first, n = gaps[g].pop()
                if n > left[s]:
                    gaps[g].append((first + left[s], n - left[s]))
                    n = left[s]
                sizes[g] -= n
            else:
                per = capacity // s
                g, n = capacity, max(1, left[s] // per)
                first, opened = opened, opened + n
            put(s, n, first, capacity - g)
            gaps[g - s].append((first, n))
            sizes[g - s] += n
    return rows


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every row, with the task and the piece's rank among the task's pieces of its length."""
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, seen, enc, width = TaskContext.get().partitionId(), defaultdict(int), encoder(tokenizer), 4 * capacity
        for batch in batches:
            for lo, hi in slices(batch):
                out = []
                part_batch = batch.slice(lo, hi - lo)
                for doc, ids in zip(part_batch.column(0).to_pylist(), enc.encode(part_batch.column(1).to_pylist()), strict=True):
                    ids += end
                    for k in range(0, len(ids), width):
                        cut = ids[k : k + width]
                        n = len(cut) // 4
                        out.append((doc, k // width, k // 4, n, zlib.crc32(cut), part, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs(doc_id, text).

    A null or empty text is its end id alone. Rows that repeat, or share a doc_id, are packed each for itself; a null
    doc_id stays null. Longer documents are cut into pieces of `capacity` ids. An empty table gives an empty result.
    Other columns are not read. Equal lengths may hold any share of the rows: ranks come from counts by task, so no
    task gathers a length.
    """
    spark = docs.sparkSession
    p = save(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = p.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = save(base.drop("n").withColumnsRenamed({"length": "l", "part": "q"}), "bases")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows = plan(histogram, capacity)
    by_length = spark.createDataFrame(rows, PLAN).groupBy(F.col("length").alias("pl")).agg(F.array_sort(F.collect_list(F.struct("rank_from", "rank_to", "sequence_from", "offset"))).alias("steps"))
    ranked = p.join(maybe_broadcast(base, base.count()), (F.col("length") == F.col("l")) & (F.col("part") == F.col("q"))).withColumn("rank", F.col("nth") + F.col("base"))
    placed = ranked.join(F.broadcast(by_length), F.col("length") == F.col("pl"))  # at most `capacity` rows
    step = F.filter("steps", lambda s: (s["rank_from"] <= F.col("rank")) & (F.col("rank") < s["rank_to"]))[0]
    placed = placed.withColumn("step", step)
    out = placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("step.sequence_from") + F.col("rank") - F.col("step.rank_from")).alias("sequence_id"), F.col("step.offset").alias("offset"))
    return out


def packed(docs: DataFrame, **options) -> DataFrame:
    """The sequences themselves: sequence_id, and its pieces in order of their place."""
    return pack(docs, **options).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length"))).alias("pieces"))


__all__ = ["pack", "packed", "pieces", "plan"]
