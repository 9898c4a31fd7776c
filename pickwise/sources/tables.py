"""Table sources and sinks: Parquet, JSON Lines (gzip too), JDBC; finite-only JSON and reason-partitioned outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines; compressed files are read by their endings."""
    return spark.read.schema(schema).json(path)


def quarantined(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The lines of JSON Lines files (gzip too) that read whole, and the others as they stand (line)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = lines.select("value", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    whole = F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()
    return read.where(whole).select("r.*").drop("_corrupt_record"), read.where(~whole).select(F.col("value").alias("line"))


def gated_files(spark: SparkSession, folder: str, most: int, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """The files of a folder that are `most` bytes at most, with their bytes, and the others, by name and size alone: the
    bytes of a file that does not pass are never read, as the test on its size reaches the scan."""
    every = files(spark, folder, pattern)
    return every.where(F.col("length") <= most).select("path", "length", "content"), every.where(F.col("length") > most).select("path", "length")


def log_page(lines: DataFrame, after: int, source: str | None = None, level: str | None = None, limit: int = 100) -> DataFrame:
    """The next page of a log after a cursor, by cursor; one row more than the limit tells that there is more."""
    cut = lines.where(F.col("cursor") > after)
    if source is not None:
        cut = cut.where(F.col("source") == source)
    if level is not None:
        cut = cut.where(F.col("level") == level)
    return cut.orderBy("cursor").limit(limit + 1)


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A folder's files with their names, sizes and bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def listing_candidates(raw: DataFrame, tie: str) -> DataFrame:
    """Rows from nested candidate lists (subject, candidates array of structs), with their place in their subject's list:
    the best voted first, then the most voted, then by `tie`."""
    rows = raw.select("subject", F.explode("candidates").alias("c")).select("subject", "c.*")
    order = Window.partitionBy("subject").orderBy(F.desc_nulls_last("vote_average"), F.desc_nulls_last("vote_count"), tie)
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def finite(value: Column, kind: T.DataType) -> Column:
    """A value with NaN and infinities as nulls, at any depth of arrays, structs and map values."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: finite(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[finite(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def write_json(df: DataFrame, path: str) -> None:
    """JSON Lines with non-finite numbers as nulls."""
    df.select(*[finite(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).write.mode("overwrite").json(path)


def output_name(stack: Column, label: Column, rank: Column, score: Column, stem: Column) -> Column:
    return F.format_string("%02d%s__%03d__%.4f__%s", stack.cast("int"), label, rank.cast("int"), score, stem)


def write_gated(df: DataFrame, path: str) -> None:
    """Rejected rows, a folder for each reason."""
    df.where(F.col("gate_reason").isNotNull()).write.mode("overwrite").partitionBy("gate_reason").parquet(path)


def load_profile(spark: SparkSession, path: str, model: str, dims: int) -> DataFrame:
    """A stored profile of exemplars; rows of another model or dimension end the query."""
    df = spark.read.parquet(path)
    same = (F.col("model") == model) & (F.size("embedding") == dims)
    return df.where(F.assert_true(F.coalesce(same, F.lit(False)), F.lit(f"profile is not of model {model} with {dims} dimensions")).isNull())
