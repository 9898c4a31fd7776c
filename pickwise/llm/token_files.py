"""Flat token files: unsigned integers one after another, 64-bit document offsets beside them, memory-mapped to read.

Documents are dealt to files by ranges of doc_id, so files in order hold ascending doc_ids. File number k is three files:
`k.ids` (token ids, uint16 where the vocabulary fits, else uint32), `k.offsets` (int64, one more than there are
documents, from 0), `k.docs` (int64 doc_ids, 0 for those that are null, which come first: the manifest tells how many). Each file starts at the sum of the tokens of the files before it: that
prefix sum over the manifest makes one address space of all of them.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, mounted, save, scratch, slices
from .tokens import encoder

MANIFEST = "file int, path string, dtype string, n_docs long, n_null long, n_tokens long"
GROUP = 4096  # files whose bases one task adds up


def write(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, vocabulary: int = 50_257, folder: str | None = None, file_bytes: int = 64_000_000, least_bytes: int = 1_000_000) -> DataFrame:
    """Encode docs(doc_id, text) into token files in ascending order of doc_id; returns the manifest with each file's base.

    A null text is empty: its end id alone. Rows with equal doc_id are all written, in order of a digest of their text (so
    one doc_id can fill several files); rows without doc_id come first. An empty table writes no files. Other columns are
    not read. There are as many files as the texts have `file_bytes`, counted in a pass of its own, but one for each core
    where these have `least_bytes` of text. Bases are prefix sums in two levels, of files within a group and of groups.
    A task writes under a name of its own attempt and renames at the end; the manifest names the files that count, so a
    lost executor's leftovers are never read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = mounted(folder or scratch(spark, "tokens"))
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches):
        from pyspark import TaskContext

        k, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        os.makedirs(folder, exist_ok=True)
        own = os.path.join(folder, f"{k:06d}-{uuid.uuid4().hex}")
        end, offsets, total, ids_seen = np.array([end_id], dtype=dtype), [np.zeros(1, dtype="<i8")], 0, 0
        nulls = 0
        with open(f"{own}.ids.part", "wb") as ids_file, open(f"{own}.docs.part", "wb") as docs_file:
            for batch in batches:
                for lo, hi in slices(batch):
                    part = batch.slice(lo, hi - lo)
                    lengths = []
                    for raw in enc.encode(part.column(1).to_pylist()):
                        ids = np.append(np.frombuffer(raw, dtype="<u4").astype(dtype), end)
                        ids_file.write(ids.tobytes())
                        lengths.append(len(ids))
                    offsets.append(total + np.cumsum(np.array(lengths, dtype="<i8")))
                    total = int(offsets[-1][-1])
                    ids_seen += len(lengths)
                    nulls += part.column(0).null_count
                    docs_file.write(part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        if ids_seen:
            np.concatenate(offsets).astype("<i8").tofile(f"{own}.offsets.part")
            for kind in ("ids", "docs", "offsets"):
                os.rename(f"{own}.{kind}.part", f"{own}.{kind}")
            yield pa.RecordBatch.from_pydict({"file": pa.array([k], pa.int32()), "path": [own], "dtype": [dtype], "n_docs": [ids_seen], "n_null": [nulls], "n_tokens": [total]})
        else:
            os.remove(f"{own}.ids.part")
            os.remove(f"{own}.docs.part")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    files = max(1, -(-size // file_bytes), min(spark.sparkContext.defaultParallelism, size // least_bytes))
    ordered = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    manifest = save(ordered.mapInArrow(run, MANIFEST).withColumn("group", F.floor(F.col("file") / GROUP)), "manifest")
    sums = manifest.groupBy("group").agg(F.sum("n_tokens").alias("n"))
    sums = sums.select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("group_base"))  # one row for GROUP files
    inside = F.sum("n_tokens").over(Window.partitionBy("group").orderBy("file")) - F.col("n_tokens")
    return manifest.withColumn("inside", inside).join(sums, "group").withColumn("base", F.col("group_base") + F.col("inside")).drop("group", "inside", "group_base")


def mapped(path: str, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, offsets, doc_ids of one file, memory-mapped."""
    return tuple(np.memmap(f"{path}.{kind}", dtype=t, mode="r") for kind, t in (("ids", dtype), ("offsets", "<i8"), ("docs", "<i8")))


def read(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches):
        for batch in batches:
            for f in batch.to_pylist():
                ids, offsets, docs = mapped(f["path"], f["dtype"])
                for lo in range(0, len(docs), 20_000):
                    hi = min(lo + 20_000, len(docs))
                    cuts = [ids[offsets[i] : offsets[i + 1]].astype("<u4") for i in range(lo, hi)]
                    cols = {"doc_id": pa.array(docs[lo:hi], mask=np.arange(lo, hi) < f["n_null"]), "start": pa.array(offsets[lo:hi] + f["base"]), "n_tokens": pa.array(np.diff(offsets[lo : hi + 1])), "ids_crc32": pa.array([zlib.crc32(c.tobytes()) for c in cuts], pa.int64())}
                    if with_ids:
                        cols["ids"] = pa.array([c.tolist() for c in cuts], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(cols)

    n = max(1, manifest.count())
    return manifest.select("file", "path", "dtype", "n_null", "base").repartition(n, "file").mapInArrow(run, schema)
