"""Tables that are published whole or not at all.

root/versions/<id> holds one version's files, root/manifests/<number> names the version that the number stands for, with its
rows and a checksum. A version is written and counted first; the manifest, one small file that is only made where no such
number is there yet, makes it the current one. Readers take the largest number. A publisher that stops half-way leaves
files that nobody reads, and of two publishers that start from one number the second is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another version was published meanwhile."""


class Damaged(RuntimeError):
    """A version's files are not what its manifest says."""


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _sums(df: DataFrame) -> tuple[int, int]:
    """Rows, and a checksum that does not hang on their order."""
    plain = [F.to_json(c) if t.startswith(("map", "struct", "array")) else F.col(c) for c, t in df.dtypes]
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*plain).cast("decimal(20,0)"))).first()
    return r[0], int(r[1] or 0)


def current(spark: SparkSession, root: str) -> int:
    """The number of the version that readers take; 0 if there is none."""
    p, fs = _at(spark, f"{root}/manifests")
    return max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=0) if fs.exists(p) else 0


def stage(df: DataFrame, root: str) -> dict:
    """Write a version that nobody reads yet; returns what its manifest will say."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{root}/versions/{name}")
    rows, checksum = _sums(df.sparkSession.read.schema(df.schema).parquet(f"{root}/versions/{name}"))
    return {"version": name, "rows": rows, "checksum": str(checksum), "schema": df.schema.json()}


def publish(df: DataFrame, root: str, after: int) -> int:
    """Publish a table as the version after number `after`, the one it was made from; returns its number."""
    spark = df.sparkSession
    said = json.dumps(stage(df, root)).encode()
    p, fs = _at(spark, f"{root}/manifests/{after + 1:010d}")
    if current(spark, root) != after:
        raise Conflict(f"version {after} is not the current one")
    try:
        out = fs.create(p, False)  # never over a number that is there
    except Exception as e:
        raise Conflict(f"version {after + 1} is there already") from e
    out.write(bytearray(said))
    out.close()
    return after + 1


def published(spark: SparkSession, root: str, check: bool = True) -> DataFrame:
    """The current version; with `check`, its rows and checksum are compared with its manifest's first."""
    number = current(spark, root)
    if not number:
        raise FileNotFoundError(f"nothing is published at {root}")
    said = json.loads("".join(r[0] for r in spark.read.text(f"{root}/manifests/{number:010d}", wholetext=True).collect()))
    schema = spark._jvm.org.apache.spark.sql.types.DataType.fromJson(said["schema"]).toDDL()
    df = spark.read.schema(schema).parquet(f"{root}/versions/{said['version']}")
    if check and _sums(df) != (said["rows"], int(said["checksum"])):
        raise Damaged(f"version {number} of {root}")
    return df
