"""Queries of the candidate dataflow, over `part` as candidates; a subject is a brand's candidates among 400 ids, so it has a bounded number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, scores
from ..operators import calibration, candidates
from ..sources.tables import table
from .registry import query

#: Stand-in measures of a candidate, by arithmetic on its key: the same text in Spark and in the checking SQL.
MEASURES = {
    "candidate_id": "p_partkey", "subject": "p_brand || ':' || CAST(floor(p_partkey / 400) AS BIGINT)", "width": "300 + (p_partkey * 37) % 900", "height": "400 + (p_partkey * 53) % 900",
    "aesthetic": "((p_partkey * 13) % 100) / 10.0", "knn_sim": "0.30 + ((p_partkey * 7) % 70) / 100.0", "title_colorfulness": "p_size * 1.5", "title_found": "p_size % 5 <> 0",
    "text_boxes": "(p_partkey * 11) % 9", "text_area": "((p_partkey * 29) % 50) / 100.0", "resolution": "p_retailprice / 400", "sharpness": "p_retailprice", "face_area": "((p_partkey * 17) % 100) / 100.0",
    "vote_average": "(p_partkey * 3) % 11", "vote_count": "(p_partkey * 19) % 60 - 3", "language": "CASE p_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' END",
    "dino_knn": "CASE WHEN p_partkey % 4 <> 0 THEN ((p_partkey * 23) % 100) / 100.0 END", "official_family": "CASE WHEN p_partkey % 7 <> 0 THEN ((p_partkey * 31) % 100) / 100.0 END",
    "blockiness": "(p_partkey * 5) % 9", "noise": "(p_partkey * 23) % 15",
}
RAW_SQL = "raw AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in MEASURES.items()) + ", p_type, p_size, p_retailprice FROM part)"
FEATURES_SQL = f"""{RAW_SQL}, feat AS (SELECT *,
  (greatest(vote_count, 0) * vote_average + 162.5) / (greatest(vote_count, 0) + 25.0) / 10 AS provenance,
  least(0.5 * least(text_boxes / 5.0, 1.0) + 0.5 * text_area, 1.0) AS text_residual,
  CASE WHEN language IS NULL THEN 0.5 WHEN language = 'en' THEN 1.0 ELSE 0.2 END AS lang_match,
  0.5 * least(blockiness / 6.0, 1.0) + 0.5 * least(noise / 12.0, 1.0) AS quality_artifacts FROM raw),
norm AS (SELECT *, greatest(0, least((knn_sim - 0.4) / 0.5, 1)) AS n_knn, least(aesthetic / 10, 1) AS n_aes,
  CASE WHEN title_found THEN least(title_colorfulness / 60, 1) ELSE 0.5 END AS n_title, 1 - text_residual AS n_text, 1 - face_area AS n_face,
  greatest(0, least(provenance, 1)) AS n_prov, least(ln(1 + sharpness) / ln(2001), 1) AS n_sharp, greatest(0, least((dino_knn - 0.4) / 0.5, 1)) AS n_dino0,
  1 - quality_artifacts AS n_qual, greatest(0, least((official_family - 0.6) / 0.35, 1)) AS n_off0 FROM feat),
norm2 AS (SELECT *, CASE WHEN dino_knn IS NOT NULL THEN n_dino0 END AS n_dino, CASE WHEN official_family IS NOT NULL THEN n_off0 END AS n_off FROM norm),
scored AS (SELECT *, (0.30 * n_knn + 0.12 * n_aes + 0.15 * n_title + 0.15 * n_face + 0.10 * n_text + 0.02 * n_prov + 0.03 * n_sharp + 0.03 * n_qual
    + coalesce(0.12 * n_dino, 0) + coalesce(0.12 * n_off, 0))
  / (0.90 + CASE WHEN n_dino IS NULL THEN 0 ELSE 0.12 END + CASE WHEN n_off IS NULL THEN 0 ELSE 0.12 END) AS score,
  CASE WHEN width < 500 THEN 'resolution_floor'
    WHEN aesthetic < 4.5 AND NOT (knn_sim >= 0.55 AND aesthetic >= 2.0) THEN 'aesthetic_floor'
    WHEN knn_sim < 0.45 THEN 'off_style_floor'
    WHEN aesthetic < 5.0 AND provenance < 0.55 AND resolution < 1.0 THEN 'fan_junk_combo' END AS gate_reason FROM norm2)"""
KEPT_SQL = f"{FEATURES_SQL}, kept AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY round(score, 9) DESC, candidate_id) AS rank FROM scored WHERE gate_reason IS NULL)"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{v} AS {k}" for k, v in MEASURES.items()], "p_type", "p_size", "p_retailprice")


def featured(df: DataFrame) -> DataFrame:
    """Raw measures to features and a weighted score; cheap features are there before any gate."""
    c = F.col
    df = df.withColumns({"provenance": scores.provenance(c("vote_average"), c("vote_count")), "text_residual": scores.text_residual(c("text_boxes"), c("text_area")), "lang_match": scores.language_match(c("language")), "quality_artifacts": scores.artifact_badness(c("blockiness"), c("noise"))})
    names = ("knn_sim", "aesthetic", "title_colorfulness", "title_found", "text_residual", "resolution", "sharpness", "face_area", "provenance", "lang_match", "dino_knn", "quality_artifacts", "official_family")
    return df.withColumn("score", scores.weighted_score(scores.normalised({k: c(k) for k in names})))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.gate(featured(raw(spark, sf_dir)), junk=True)


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir).where(F.col("gate_reason").isNull()).withColumn("by", F.round("score", 9))
    return candidates.rank(df, score="by")


@query(f"WITH {KEPT_SQL} SELECT subject, candidate_id, round(score, 6) AS score, rank FROM kept WHERE rank <= 3")
def weighted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best candidates of each subject that pass all gates."""
    return kept(spark, sf_dir).where(F.col("rank") <= 3).select("subject", "candidate_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {FEATURES_SQL} SELECT subject, count(*) AS fetched, count(*) FILTER (WHERE gate_reason = 'resolution_floor') AS too_small,
  count(*) FILTER (WHERE gate_reason IN ('aesthetic_floor', 'off_style_floor')) AS off_style, count(*) FILTER (WHERE gate_reason = 'fan_junk_combo') AS junk,
  count(*) FILTER (WHERE gate_reason IS NULL) AS passed FROM scored GROUP BY subject""")
def gate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates of each subject each gate lets through."""
    r = F.col("gate_reason")
    return scored(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(r == "resolution_floor").alias("too_small"), F.count_if(r.isin("aesthetic_floor", "off_style_floor")).alias("off_style"), F.count_if(r == "fan_junk_combo").alias("junk"), F.count_if(r.isNull()).alias("passed"))


@query(f"""WITH {FEATURES_SQL}, h AS (SELECT subject, gate_reason, count(*) AS n FROM scored WHERE gate_reason IS NOT NULL GROUP BY ALL)
SELECT subject, gate_reason, n, row_number() OVER (PARTITION BY subject ORDER BY n DESC, gate_reason) = 1 AS dominant FROM h""")
def rejection_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections of each subject by reason, with the commonest marked (equal counts: the first by name)."""
    h = scored(spark, sf_dir).where(F.col("gate_reason").isNotNull()).groupBy("subject", "gate_reason").agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("dominant", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("n"), "gate_reason")) == 1)


@query(f"""WITH {FEATURES_SQL}, a AS (SELECT subject, candidate_id, score, row_number() OVER (PARTITION BY subject ORDER BY round(score, 9) DESC, candidate_id) AS previous_rank FROM scored WHERE gate_reason IS NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY round(rescored, 9) DESC, candidate_id) AS new_rank FROM (SELECT a.subject, a.candidate_id, a.previous_rank, (0.5 * n_knn + 0.5 * n_aes) AS rescored FROM a JOIN scored s USING (candidate_id)))
SELECT subject, candidate_id, previous_rank, new_rank, previous_rank - new_rank AS moved, round(rescored, 6) AS rescored FROM b""")
def rescore_rank_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored features scored by other weights: old and new rank."""
    old = kept(spark, sf_dir).withColumnRenamed("rank", "previous_rank")
    n = scores.normalised({"knn_sim": F.col("knn_sim"), "aesthetic": F.col("aesthetic")})
    new = old.withColumn("rescored", scores.weighted_score(n, {"knn_sim": 0.5, "aesthetic": 0.5})).withColumn("by", F.round("rescored", 9))
    new = candidates.rank(new, score="by", name="new_rank")
    return new.select("subject", "candidate_id", "previous_rank", "new_rank", (F.col("previous_rank") - F.col("new_rank")).alias("moved"), F.round("rescored", 6).alias("rescored"))


@query(f"""WITH {FEATURES_SQL}, r AS (SELECT candidate_id, least(greatest(score, 0.000001), 0.999999) AS p, greatest(-0.75, least(0.9 * n_knn - 0.6 * n_aes + 0.1, 0.75)) AS delta FROM scored)
SELECT candidate_id, round(1 / (1 + exp(-(ln(p / (1 - p)) + 0.5 * delta))), 6) AS residual FROM r""")
def residual_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted score moved by a bounded residual on the logit scale."""
    df = scored(spark, sf_dir)
    n = scores.normalised({"knn_sim": F.col("knn_sim"), "aesthetic": F.col("aesthetic")})
    return df.select("candidate_id", F.round(scores.residual_score(F.col("score"), n, {"knn_sim": 0.9, "aesthetic": -0.6}, bias=0.1), 6).alias("residual"))


@query(f"""WITH {FEATURES_SQL}, u AS (SELECT candidate_id, unnest(['knn_sim', 'aesthetic', 'title_colorfulness', 'face_area', 'text_residual', 'provenance', 'sharpness', 'dino_knn', 'quality_artifacts', 'official_family']) AS feature,
  unnest([0.30 * n_knn, 0.12 * n_aes, 0.15 * n_title, 0.15 * n_face, 0.10 * n_text, 0.02 * n_prov, 0.03 * n_sharp, 0.12 * n_dino, 0.03 * n_qual, 0.12 * n_off]) AS v FROM scored)
SELECT candidate_id, feature, round(v, 6) AS contribution, row_number() OVER (PARTITION BY candidate_id ORDER BY round(v, 9) DESC, feature) AS nth FROM u WHERE round(v, 9) > 0 QUALIFY nth <= 3""")
def top_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest positive parts of each candidate's score, of all weighted features that it has."""
    c = F.col
    df = scored(spark, sf_dir)
    weights = {k: w for k, w in fixed.WEIGHTS.items() if w > 0 and k in df.columns}
    n = scores.normalised({k: c(k) for k in (*weights, "title_found")})
    parts = F.array(*[F.struct((-F.round(n[k] * w, 9)).alias("neg"), F.lit(k).alias("feature"), (n[k] * w).alias("v")) for k, w in weights.items()])
    best = F.slice(F.array_sort(F.filter(parts, lambda s: F.coalesce(s["neg"] < 0, F.lit(False)))), 1, 3)
    out = df.select("candidate_id", F.posexplode(best).alias("i", "s"))
    return out.select("candidate_id", "s.feature", F.round("s.v", 6).alias("contribution"), (F.col("i") + 1).cast("long").alias("nth"))


@query(f"""WITH {RAW_SQL}, h AS (SELECT *, substr(sha256(p_type || ':' || CAST(p_size AS VARCHAR)), 1, 12) AS content FROM raw)
SELECT candidate_id, content, first_value(candidate_id) OVER w AS kept_id, candidate_id = first_value(candidate_id) OVER w AS is_kept FROM h
WINDOW w AS (PARTITION BY subject, content ORDER BY CASE WHEN language = 'en' THEN 0 ELSE 1 END, width * height DESC, candidate_id)""")
def exact_dedup_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a subject's candidates with equal content, the preferred language and then the most pixels are kept."""
    df = raw(spark, sf_dir).withColumn("content", F.substring(F.sha2(F.concat("p_type", F.lit(":"), F.col("p_size").cast("string")), 256), 1, 12))
    order = [F.when(F.col("language") == "en", 0).otherwise(1), F.desc(F.col("width") * F.col("height")), F.col("candidate_id")]
    return candidates.exact_duplicates(df, ["subject", "content"], order).select("candidate_id", "content", "kept_id", "is_kept")


@query(f"""WITH {RAW_SQL}, t AS (SELECT subject, p_type, candidate_id, row_number() OVER (PARTITION BY subject, p_type ORDER BY sha256('seed:' || candidate_id)) AS turn FROM raw)
SELECT subject, candidate_id, row_number() OVER (PARTITION BY subject ORDER BY turn, sha256('family:' || p_type), p_type) AS place FROM t""")
def round_robin_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order without preference: families take turns, in hash order, hash order inside them."""
    sha = lambda prefix, c: F.sha2(F.concat(F.lit(prefix), F.col(c).cast("string")), 256)
    df = raw(spark, sf_dir).withColumn("turn", F.row_number().over(Window.partitionBy("subject", "p_type").orderBy(sha("seed:", "candidate_id"))))
    place = F.row_number().over(Window.partitionBy("subject").orderBy("turn", sha("family:", "p_type"), "p_type"))
    return df.select("subject", "candidate_id", place.cast("long").alias("place"))


@query(f"""WITH {RAW_SQL}, t AS (SELECT subject, candidate_id, p_size >= 40 AS accepted, p_size < 10 AS textless FROM raw)
SELECT subject, candidate_id, accepted OR (NOT bool_or(accepted) OVER (PARTITION BY subject) AND textless) AS final FROM t""")
def fallback_if_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Textless candidates count only in subjects that have no accepted one."""
    df = raw(spark, sf_dir).select("subject", "candidate_id", (F.col("p_size") >= 40).alias("accepted"), (F.col("p_size") < 10).alias("textless"))
    return candidates.only_if_none_accepted(df, "accepted", "textless").select("subject", "candidate_id", "final")


@query(f"""WITH {KEPT_SQL} SELECT subject, candidate_id, printf('%02d%s__%03d__%.4f__%s', 1, CASE WHEN rank <= 26 THEN chr(CAST(64 + rank AS INTEGER)) ELSE chr(CAST(64 + (rank - 1) // 26 AS INTEGER)) || chr(CAST(65 + (rank - 1) % 26 AS INTEGER)) END, rank, round(score, 3) + 0.00001, 'c' || candidate_id) AS output FROM kept WHERE rank <= 120""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name under which each of the best 120 candidates of a subject is put out."""
    from ..sources.tables import output_name

    df = kept(spark, sf_dir).where(F.col("rank") <= 120)
    name = output_name(F.lit(1), scores.position_label(F.col("rank")), F.col("rank"), F.round("score", 3) + 0.00001, F.concat(F.lit("c"), "candidate_id"))
    return df.select("subject", "candidate_id", name.alias("output"))


CALIBRATION_SQL = """s AS (SELECT p_type AS feature, CAST(p_size AS DOUBLE) AS value FROM part),
b AS (SELECT feature, count(*) AS n, stddev_pop(value) AS std, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(abs(value)) AS anchor FROM s GROUP BY feature HAVING count(*) >= 20),
w AS (SELECT *, CASE WHEN least(CASE WHEN std > 0 THEN std ELSE 1e300 END, CASE WHEN q3 > q1 THEN (q3 - q1) / 1.349 ELSE 1e300 END) < 1e300
  THEN 0.9 * least(CASE WHEN std > 0 THEN std ELSE 1e300 END, CASE WHEN q3 > q1 THEN (q3 - q1) / 1.349 ELSE 1e300 END) * pow(n, -0.2) ELSE greatest(0.05 * anchor, 0.001) END AS bw FROM b)"""


@query(f"""WITH {CALIBRATION_SQL}, x AS (SELECT DISTINCT feature, value FROM s),
d AS (SELECT x.feature, x.value, avg(exp(-0.5 * pow((x.value - s.value) / bw, 2))) AS density FROM x JOIN w USING (feature) JOIN s ON s.feature = x.feature GROUP BY ALL)
SELECT feature, value, round(least(density / max(density) OVER (PARTITION BY feature), 1.0), 6) AS typicality FROM d""")
def kde_typicality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How typical each size is of its part type, by kernel density."""
    s = table(spark, sf_dir, "part").select(F.col("p_type").alias("feature"), F.col("p_size").cast("double").alias("value"))
    return calibration.typicality(s.distinct(), s).select("feature", "value", F.round("typicality", 6).alias("typicality"))


@query(f"WITH {CALIBRATION_SQL} SELECT feature, n, round(median, 6) AS median, round(bw, 6) AS bandwidth FROM w")
def calibration_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select(F.col("p_type").alias("feature"), F.col("p_size").cast("double").alias("value"))
    return calibration.bands(s).select("feature", "n", F.round("median", 6).alias("median"), F.round("bandwidth", 6).alias("bandwidth"))


@query()
def stack_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-linkage stacks of the vectors of each (label, bucket of 400 ids), at a similarity that random vectors reach."""
    e = table(spark, sf_dir, "embeddings").select(F.concat_ws(":", "label", F.floor(F.col("vec_id") / 400)).alias("subject"), F.col("vec_id").alias("candidate_id"), ((F.col("vec_id") * 7) % 101 / 100).alias("score"), "embedding")
    return candidates.stacks(e, threshold=0.2)


@query()
def greedy_phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy groups of near-equal 64-bit hashes in each (brand, bucket of 400 ids)."""
    df = raw(spark, sf_dir).select("subject", "candidate_id", F.expr("xxhash64(p_type) ^ shiftleft(1L, p_size % 60)").alias("phash"), (F.col("width") * F.col("height")).alias("pixels"))
    return candidates.greedy_near_duplicates(df)


@query()
def duplicate_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What near duplicates of whole brands lose, to which, how far off, and why."""
    df = raw(spark, sf_dir).select(F.substring_index("subject", ":", 1).alias("subject"), "candidate_id", F.expr("xxhash64(p_type) ^ shiftleft(1L, p_size % 60)").alias("phash"), (F.col("width") * F.col("height")).alias("pixels"))
    return candidates.duplicate_ledger(candidates.greedy_near_duplicates(df))


@query(f"WITH {RAW_SQL} SELECT CAST(g AS BIGINT) AS chunk, count(*) AS members, min(candidate_id) AS first_id, max(candidate_id) AS last_id FROM (SELECT candidate_id, (row_number() OVER (PARTITION BY subject ORDER BY candidate_id) - 1) // 8 AS g FROM raw) GROUP BY g")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's candidates in ordered chunks of eight, chunk numbers taken together."""
    nth = F.row_number().over(Window.partitionBy("subject").orderBy("candidate_id")) - 1
    return raw(spark, sf_dir).select("candidate_id", F.floor(nth / 8).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("members"), F.min("candidate_id").alias("first_id"), F.max("candidate_id").alias("last_id"))
