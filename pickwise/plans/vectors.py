"""Queries over `embeddings`: every fiftieth vector asks, all vectors are the profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, unit
from ..operators import neighbours as nn
from ..operators import ranks
from ..sources.tables import table
from .registry import query

c = F.col
UNIT_SQL = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
SIM_SQL = UNIT_SQL + ", s AS (SELECT q.vec_id AS query_id, q.label AS query_label, p.vec_id AS exemplar_id, p.label AS label, list_dot_product(q.v, p.v) AS sim FROM u q, u p WHERE q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id)"
TOP_SQL = SIM_SQL + ", t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, exemplar_id) AS r FROM s QUALIFY r <= 10)"
SOFT_SQL = TOP_SQL + ", w AS (SELECT *, exp((sim - max(sim) OVER (PARTITION BY query_id)) / 0.1) AS e FROM t)"


def sides(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 50 = 0").select(c("vec_id").alias("query_id"), "embedding", c("label").alias("query_label")), e.select(c("vec_id").alias("exemplar_id"), "embedding", "label")


@query(f"WITH {SOFT_SQL} SELECT query_id, round(sum(e * sim) / sum(e), 6) AS style FROM w GROUP BY query_id")
def knn_softmax_score(spark, sf_dir):
    q, p = sides(spark, sf_dir)
    return nn.style_score(q, p).select("query_id", F.round("style", 6).alias("style"))


@query(f"""WITH {SIM_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id, label % 2 ORDER BY round(sim, 12) DESC, exemplar_id) AS r FROM s QUALIFY r <= 10),
w AS (SELECT *, exp((sim - max(sim) OVER (PARTITION BY query_id, label % 2)) / 0.1) AS e FROM t),
a AS (SELECT query_id, sum(e * sim) FILTER (WHERE label % 2 = 0) / sum(e) FILTER (WHERE label % 2 = 0) AS pos, sum(e * sim) FILTER (WHERE label % 2 = 1) / sum(e) FILTER (WHERE label % 2 = 1) AS neg FROM w GROUP BY query_id)
SELECT query_id, round(pos - greatest(0, neg - pos), 6) AS score FROM a""")
def contrastive_score(spark, sf_dir):
    """Nearness to liked exemplars less what nearness to disliked ones exceeds it by."""
    q, p = sides(spark, sf_dir)
    pos = nn.style_score(q, p.where(c("label") % 2 == 0)).withColumnRenamed("style", "pos")
    neg = nn.style_score(q, p.where(c("label") % 2 == 1)).withColumnRenamed("style", "neg")
    return pos.join(neg, "query_id", "left").select("query_id", F.round(nn.contrastive(c("pos"), c("neg")), 6).alias("score"))


@query(f"WITH {TOP_SQL} SELECT query_id, exemplar_id, round(sim, 6) AS similarity, r AS rank FROM t")
def self_knn(spark, sf_dir):
    """Exemplars' neighbours among all the others."""
    q, p = sides(spark, sf_dir)
    return nn.nearest(q, p).select("query_id", "exemplar_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""WITH {SOFT_SQL}, k AS (SELECT query_id, sum(e * sim) / sum(e) AS style FROM w GROUP BY query_id), b AS (SELECT quantile_cont(round(style, 9), 0.05) AS p5, quantile_cont(round(style, 9), 0.95) AS p95 FROM k)
SELECT query_id, round(style, 6) AS style, round(p5, 6) AS p5, round(p95, 6) AS p95 FROM k, b WHERE round(style, 9) <= p5""")
def outliers_p5(spark, sf_dir):
    """Exemplars whose style is at or under the fifth percentile, beside the range of all."""
    q, p = sides(spark, sf_dir)
    s = nn.style_score(q, p).withColumn("s", F.round("style", 9))
    b = ranks.quantiles(s, "s", {"p5": 0.05, "p95": 0.95})
    return s.crossJoin(F.broadcast(b)).where(c("s") <= c("p5")).select("query_id", F.round("style", 6).alias("style"), F.round("p5", 6).alias("p5"), F.round("p95", 6).alias("p95"))


@query(f"""WITH {SIM_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id, label % 2 ORDER BY round(sim, 12) DESC, exemplar_id) AS r FROM s QUALIFY r <= 10),
m AS (SELECT query_id, any_value(query_label) AS own, avg(sim) FILTER (WHERE label % 2 = 0) AS pos, avg(sim) FILTER (WHERE label % 2 = 1) AS neg FROM t GROUP BY query_id),
ce AS (SELECT i, avg(v[i]) AS x FROM u, range(1, 65) g(i) WHERE label % 2 = 0 GROUP BY i), cl AS (SELECT list(x / (SELECT sqrt(sum(x * x)) FROM ce) ORDER BY i) AS v FROM ce),
cs AS (SELECT avg(list_dot_product(u.v, cl.v)) AS centre_mean, stddev_pop(list_dot_product(u.v, cl.v)) AS centre_std FROM u, cl WHERE label % 2 = 0)
SELECT round(centre_mean, 6) AS centre_mean, round(centre_std, 6) AS centre_std, (SELECT round(avg(pos), 6) FROM m WHERE own % 2 = 0) AS near_mean, (SELECT round(stddev_pop(pos), 6) FROM m WHERE own % 2 = 0) AS near_std,
  (SELECT round(avg(neg - pos), 6) FROM m WHERE own % 2 = 1) AS margin_mean, (SELECT round(min(neg - pos), 6) FROM m WHERE own % 2 = 1) AS margin_least FROM cs""")
def profile_diagnostics(spark, sf_dir):
    """How tight the liked exemplars are (to their centre, to their neighbours), and how far the disliked keep to themselves."""
    q, p = sides(spark, sf_dir)
    liked = p.where("label % 2 = 0")
    mean = lambda profile: nn.nearest(q, profile).groupBy("query_id").agg(F.avg("similarity").alias("m"))
    m = q.select("query_id", "query_label").join(mean(liked).withColumnRenamed("m", "pos"), "query_id").join(mean(p.where("label % 2 = 1")).withColumnRenamed("m", "neg"), "query_id", "left")
    own, other = c("query_label") % 2 == 0, c("query_label") % 2 == 1
    margin = F.when(other, c("neg") - c("pos"))
    near = m.agg(F.round(F.avg(F.when(own, c("pos"))), 6).alias("near_mean"), F.round(F.stddev_pop(F.when(own, c("pos"))), 6).alias("near_std"), F.round(F.avg(margin), 6).alias("margin_mean"), F.round(F.min(margin), 6).alias("margin_least"))
    centre = nn.centroid(liked.withColumn("all", F.lit(1)), "all").select("centroid")
    s = liked.crossJoin(F.broadcast(centre)).select(cosine(c("embedding"), c("centroid")).alias("s"))  # one vector
    return s.agg(F.round(F.avg("s"), 6).alias("centre_mean"), F.round(F.stddev_pop("s"), 6).alias("centre_std")).crossJoin(near)


@query(f"""WITH {UNIT_SQL}, m AS (SELECT label, i, avg(v[i]) AS x FROM u, range(1, 65) t(i) GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS l FROM m GROUP BY label)
SELECT label, i - 1 AS place, round(x / l, 6) AS x FROM m JOIN n USING (label)""")
def centroid(spark, sf_dir):
    """Each label's normalised centroid, by place."""
    out = nn.centroid(table(spark, sf_dir, "embeddings"), "label").select("label", F.posexplode("centroid").alias("place", "x"))
    return out.select("label", c("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query(f"WITH {SOFT_SQL} SELECT query_id, round(sum(e * (exemplar_id % 7)) / sum(e), 6) AS x, round(sum(e * (exemplar_id % 11)) / sum(e), 6) AS y FROM w GROUP BY query_id")
def barycentric(spark, sf_dir):
    """Candidates placed between their neighbours' map coordinates."""
    q, p = sides(spark, sf_dir)
    top = nn.softmax_weights(nn.nearest(q, p))
    return top.groupBy("query_id").agg(F.round(F.sum(c("weight") * (c("exemplar_id") % 7)), 6).alias("x"), F.round(F.sum(c("weight") * (c("exemplar_id") % 11)), 6).alias("y"))


@query(f"WITH {UNIT_SQL} SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS family FROM u a JOIN (SELECT label, v FROM u QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) b USING (label)")
def anchor_family(spark, sf_dir):
    """Cosine to the anchor (the first vector) of one's own label."""
    e = table(spark, sf_dir, "embeddings")
    anchor = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    return e.join(anchor, "label").select("vec_id", F.round(cosine(c("embedding"), c("anchor")), 6).alias("family"))


@query("""WITH g AS (SELECT label, 'w' || (vec_id % 5) AS genre, count(*) AS n FROM embeddings GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, genre) AS k FROM g)
SELECT label, string_agg(genre, ' / ' ORDER BY k) || ' (' || (SELECT count(*) FROM embeddings e WHERE e.label = r.label) || ')' AS name FROM r WHERE k <= 2 GROUP BY label""")
def cluster_names(spark, sf_dir):
    """A cluster's name: its two commonest genres and its size."""
    e = table(spark, sf_dir, "embeddings")
    g = e.groupBy("label", F.concat(F.lit("w"), c("vec_id") % 5).alias("genre")).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "genre"))).withColumn("size", F.sum("n").over(Window.partitionBy("label")))
    top = g.where(c("k") <= 2).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "genre"))).alias("s"), F.max("size").alias("size"))
    return top.select("label", F.concat(F.array_join("s.genre", " / "), F.lit(" ("), c("size").cast("string"), F.lit(")")).alias("name"))


@query()
def pca_map(spark, sf_dir):
    """The profile projected on its three principal axes (signs are arbitrary; the tests compare each axis' variance with an eigenvalue)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(unit(c("embedding"))).alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="x", withMean=True, withStd=False).fit(e).transform(e)
    xyz = PCA(k=3, inputCol="x", outputCol="p").fit(centred).transform(centred).select("vec_id", vector_to_array("p").alias("p"))
    return xyz.select("vec_id", c("p")[0].alias("x"), c("p")[1].alias("y"), c("p")[2].alias("z"))

