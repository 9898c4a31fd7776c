"""The corpus pipeline: toxic texts go, unknown languages go, one of each group of near copies stays, sources are mixed
to their targets, the mix is packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame that is written
as Parquet and read again as the next one's docs; all but the last return the columns of documents. The classifiers are
fitted on the stage's own documents. A document that the mix repeats stands in it as often as it was taken.

Rows with null or empty texts pass the toxicity stage (the model's bias alone speaks) and are turned away by the
language stage, which calls them `und`. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pickwise.llm import jaccard, language, mixing, packing, toxicity
from pickwise.llm.common import discard, load, save

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.7. Repeated rows go or stay together; a score of 0.7 goes."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; `und` and scores under 0.3 go. Repeated rows go or stay together; a score of 0.3 stays."""
    return language.keep_known(docs, language.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by five-word shingles at a similarity of 0.8 or more.

    Of equal doc_ids the smallest set key, then text, stays; rows without words and rows without doc_id all stay.
    """
    return jaccard.keep_first(docs, words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources weigh 1, 2, 3, repeating, and none is taken over three times.

    Rows that repeat share out their copies in turn, in order of text.
    """
    none = F.lit(-(2**63))  # stands for a null doc_id, so that the join below is one of plain equality
    taken = mixing.mix(docs).where(F.col("taken") > 0)
    share = taken.groupBy(F.coalesce("doc_id", none).alias("m_key"), F.col("source").alias("m_source"), F.col("size").alias("m_size")).agg(F.sum(F.col("taken") / F.col("size")).cast("long").alias("m_times"))
    own = docs.withColumns({"_key": F.coalesce("doc_id", none), "_size": F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")})
    j = own.join(share, (F.col("_key") == F.col("m_key")) & (F.col("_size") == F.col("m_size")) & F.col("source").eqNullSafe(F.col("m_source")))
    # Rows equal in all that the mix reads share out their copies in turn.
    same = Window.partitionBy("_key", "_size", "source")
    nth, rows = F.row_number().over(same.orderBy("text")) - 1, F.count(F.lit(1)).over(same)
    times = (F.floor(F.col("m_times") / rows) + (nth < F.col("m_times") % rows).cast("long")).cast("int")
    return j.withColumn("_times", times).select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col("_times"))).alias("_copy")).drop("_copy")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's pieces and their places in sequences of 2048 tokens. Repeated rows are packed each for itself."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("language", known_language), ("near_copies", one_of_each), ("mix", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's table is deleted once the next one is written (the last one's input stays,
    as the result reads it)."""
    docs, before = load(spark, sf_dir, "documents", COLUMNS), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = save(docs, f"stage-{name}")
            if before is not None:
                discard(before)
            before = docs
    return docs
