"""Shared pieces of the text operators: shared scratch tables, table loading, bounded word memos."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts, as it stands inside a regular expression's brackets.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def load(spark: SparkSession, sf_dir: str, table: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster shares (spark.checkpoint.dir). Where that is unset, one machine's own
    folder serves one machine; a cluster is refused, as its executors would each write to their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'pickwise')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's default where the session leaves it at that: texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "1") == "1":  # the value given here comes back where nobody has set one
        spark.conf.set(key, str(rows))


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and fixes whatever row order a later step relies on."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of save() that no later step reads."""
    for t in tables:
        remove(t.sparkSession, t.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mounted(path: str) -> str:
    """The POSIX path of a file:// folder; memory-mapped files need a mounted shared file system."""
    u = urlparse(path)
    if u.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped token files need a mounted shared folder, not {path}")
    return u.path


def maybe_broadcast(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """A broadcast hint only where the counted rows stay under the limit; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


def slices(batch: pa.RecordBatch, chars: int = 4_000_000, column: str = "text"):
    """Row ranges of a batch with a bounded amount of text in each, so that one range fits the worker's memory."""
    offsets = batch.column(batch.schema.get_field_index(column))
    n, start, size = batch.num_rows, 0, 0
    lengths = pc.fill_null(pc.binary_length(offsets), 0).to_pylist()
    for i in range(n):
        size += lengths[i]
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < n:
        yield start, n


class Memo(dict):
    """word -> value for the words seen lately; emptied when it holds `limit` words, so its memory is bounded."""

    def __init__(self, compute_many, limit: int = 400_000):
        super().__init__()
        self.compute_many, self.limit = compute_many, limit

    def ensure(self, words) -> None:
        """Make all given words present (computed together)."""
        new = [w for w in words if w not in self]
        if not new:
            return
        if len(self) + len(new) > self.limit:
            self.clear()
            new = list(words)
        self.update(zip(new, self.compute_many(new), strict=True))
