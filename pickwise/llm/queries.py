"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cap_links, chat, extraction, jaccard, language, mixing, nearest, packing, phrases, repeats, token_files, toxicity, whitening
from .common import load


def op1_lstm_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(load(spark, sf_dir, "pages", ["page_id", "url", "html"]), extraction.fit())


def op2_rtree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(load(spark, sf_dir, "documents", ["doc_id", "text"]), words=4, percent=85)


def op3_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return nearest.search(rows, rows.where("vec_id % 20 = 0"), k=20)


def op4_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_trees(chat.thread(rows))).drop("leaf_id")


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", ["doc_id", "text"])
    return toxicity.score(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents", ["doc_id", "text"]))


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents", ["doc_id", "text", "source"])).select("doc_id", "size", "source_size", "target", "taken")


def op8_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    return language.predict(docs, language.fit(docs))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(spark, token_files.write(load(spark, sf_dir, "documents", ["doc_id", "text"])))


def op10_cap_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_links.near_copies(load(spark, sf_dir, "embeddings"))


def op11_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), components=32)


def op12_pattern_growth_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(load(spark, sf_dir, "documents", ["lang", "text"]), least=30, top=2000)


def op13_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(load(spark, sf_dir, "documents", ["doc_id", "text"]), length=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lstm_main_text, op2_rtree_jaccard, op4_reply_tree_chat, op3_anisotropic_search, op5_counterfactual_toxicity, op6_best_fit_packing, op7_pareto_mixing, op8_byte_gru_language, op9_token_files, op10_cap_near_copies, op11_lanczos_whitening, op12_pattern_growth_phrases, op13_suffix_repeats)}
ORACLE_SQL: dict[str, str] = {"op7_pareto_mixing": mixing.ORACLE, "op12_pattern_growth_phrases": phrases.ORACLE}
