"""Queries of preference evidence: orders as events, their lines as what was shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import exemplars, pairs
from ..sources import scratch
from ..sources.tables import table
from .registry import query

c = F.col


def shown(spark, sf_dir: str) -> DataFrame:
    """An event for each order: its lines were shown, ranked by price; what it does depends on its status."""
    once = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_returnflag")
    f = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(once)).where(c("k") == 1)
    f = f.withColumn("baseline_rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")))
    e = f.groupBy(c("l_orderkey").alias("event_id")).agg(F.array_sort(F.collect_list(F.struct("baseline_rank", c("l_linenumber").cast("string").alias("candidate_id"), "l_returnflag"))).alias("exposed"))
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("event_id"), c("o_custkey").alias("subject"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    e = e.join(o, "event_id")
    action = F.when(c("o_orderstatus") == "F", "rank").when(c("o_orderstatus") == "P", "override").otherwise("approval")
    ids = lambda keep: F.transform(F.filter("exposed", keep), lambda x: x["candidate_id"])
    return e.select("event_id", "subject", action.alias("action"), (c("o_orderpriority") == "5-LOW").alias("neutral"), (c("o_totalprice") > 400000).alias("revoked"), F.lit("2").alias("selected"), ids(lambda x: x["l_returnflag"] == "N").alias("ordered"), ids(lambda x: x["l_returnflag"] == "R").alias("hated"), "exposed")


SHOWN_SQL = """once AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_returnflag) = 1),
f AS (SELECT l_orderkey AS event_id, o_custkey AS subject, CAST(l_linenumber AS VARCHAR) AS id, l_returnflag AS flag, o_orderstatus AS status,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM once JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority <> '5-LOW' AND o_totalprice <= 400000),
p AS (SELECT a.event_id, a.subject, a.id AS winner_id, b.id AS loser_id, 'strong' AS confidence, 1.0 AS w FROM f a JOIN f b USING (event_id) WHERE a.status = 'F' AND a.flag = 'N' AND b.flag = 'N' AND a.r < b.r
 UNION ALL SELECT a.event_id, a.subject, a.id, b.id, 'explicit', 1.0 FROM f a JOIN f b USING (event_id) WHERE a.status = 'F' AND a.flag = 'N' AND b.flag = 'R'
 UNION ALL SELECT a.event_id, a.subject, a.id, b.id, 'strong', 1.0 FROM f a JOIN f b USING (event_id) WHERE a.status = 'P' AND a.id = '2' AND b.id <> '2' AND b.r = 1
 UNION ALL SELECT event_id, subject, winner_id, loser_id, 'weak', 0.25 FROM (SELECT a.event_id, a.subject, a.id AS winner_id, b.id AS loser_id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.r, b.id) AS k
   FROM f a JOIN f b USING (event_id) WHERE a.status = 'O' AND a.id = '2' AND b.id <> '2' AND abs(b.r - a.r) <= 3) WHERE k <= 3),
q AS (SELECT event_id, subject, winner_id, loser_id, confidence, CAST(w AS DOUBLE) / sum(CAST(w AS DOUBLE)) OVER (PARTITION BY event_id) AS weight FROM p)"""
SPLIT_SQL = """s AS (SELECT DISTINCT o_custkey AS subject FROM orders), d AS (SELECT subject, row_number() OVER (ORDER BY sha256('0:' || subject), subject) - 1 AS i, count(*) OVER () AS n FROM s),
k AS (SELECT *, greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)) AS v, greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT)) AS t FROM d),
part AS (SELECT subject, CASE WHEN i < n - v - t THEN 'train' WHEN i < n - t THEN 'validation' ELSE 'test' END AS part FROM k)"""


@query(f"WITH {SHOWN_SQL} SELECT event_id, winner_id, loser_id, confidence, round(weight, 6) AS weight FROM q")
def pref_pairs(spark, sf_dir):
    """Winner and loser pairs from what was shown, each event's weights adding up to one."""
    return pairs.build_pairs(shown(spark, sf_dir)).select("event_id", "winner_id", "loser_id", "confidence", F.round("weight", 6).alias("weight"))


@query(f"WITH {SPLIT_SQL} SELECT subject, part FROM part")
def subject_split(spark, sf_dir):
    """Whole subjects to train, validation and test, in hash order."""
    return pairs.split_subjects(table(spark, sf_dir, "orders").select(c("o_custkey").alias("subject")))


@query(f"""WITH {SHOWN_SQL}, {SPLIT_SQL} SELECT part, count(*) AS pairs, count(DISTINCT q.subject) AS subjects, round(sum(CASE WHEN CAST(winner_id AS INT) < CAST(loser_id AS INT) THEN weight ELSE 0 END) / sum(weight), 6) AS accuracy FROM q JOIN part ON part.subject = q.subject GROUP BY part""")
def pair_accuracy(spark, sf_dir):
    """Weighted accuracy of a plain rule (the lower line number wins) on each part."""
    q = pairs.build_pairs(shown(spark, sf_dir))
    s = pairs.split_subjects(table(spark, sf_dir, "orders").select(c("o_custkey").alias("subject")))
    right = c("winner_id").cast("int") < c("loser_id").cast("int")
    return q.join(s, "subject").groupBy("part").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("subject").alias("subjects"), F.round(pairs.weighted_accuracy(right, c("weight")), 6).alias("accuracy"))


@query(f"WITH {SHOWN_SQL} SELECT confidence, count(*) AS pairs, count(DISTINCT event_id) AS events, count(DISTINCT subject) AS subjects, round(sum(weight), 4) AS weight FROM q GROUP BY confidence")
def residual_eligibility(spark, sf_dir):
    """How much evidence there is of each kind."""
    q = pairs.build_pairs(shown(spark, sf_dir))
    return q.groupBy("confidence").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("event_id").alias("events"), F.count_distinct("subject").alias("subjects"), F.round(F.sum("weight"), 4).alias("weight"))


@query("""WITH h AS (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS evidence, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, n, sha256(evidence) AS digest FROM h""")
def evidence_digest(spark, sf_dir):
    """A digest of each subject's sorted evidence, which freezes a revision (a subject's evidence is bounded)."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ","), 256).alias("digest"))


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_totalprice <= 300000) WHERE k = 1""")
def active_after_revocation(spark, sf_dir):
    """The fold of an immutable log: revoked events drop out, the latest of each subject stands."""
    o = table(spark, sf_dir, "orders")
    revoked = o.where("o_totalprice > 300000").select("o_orderkey")
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return o.join(revoked, "o_orderkey", "left_anti").withColumn("k", k).where(c("k") == 1).select("o_custkey", "o_orderkey", "o_orderdate")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) <= 2""")
def capped_negatives(spark, sf_dir):
    """At most two of each kind for each subject, the first ones."""
    f = table(spark, sf_dir, "lineitem")
    k = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber"))
    return f.withColumn("k", k).where(c("k") <= 2).select("l_orderkey", "l_linenumber")


@query(f"""WITH {SPLIT_SQL} SELECT a.part AS a, b.part AS b, count(*) AS common FROM part a JOIN part b ON a.subject = b.subject GROUP BY ALL""")
def split_overlap_proof(spark, sf_dir):
    """No subject stands in two parts: only equal parts have subjects in common."""
    s = pairs.split_subjects(table(spark, sf_dir, "orders").select(c("o_custkey").alias("subject")))
    return s.select("subject", c("part").alias("a")).join(s.select("subject", c("part").alias("b")), "subject").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))


@query()
def active_exemplars(spark, sf_dir):
    """Which choices stand: one per customer, and one of 400 pictures for one customer at a time; some are withdrawn later."""
    o = table(spark, sf_dir, "orders")
    day = F.unix_date(c("o_orderdate").cast("date")).cast("long")
    at = day * 10_000_000_000 + c("o_orderkey")
    log = o.select(c("o_orderkey").alias("exemplar"), c("o_custkey").alias("subject"), (c("o_orderkey") * 7919 % 400).alias("picture"), at.alias("at"), F.when(c("o_orderkey") % 6 == 0, (day + 40) * 10_000_000_000).alias("revoked"))
    return exemplars.activate(log)


@query()
def residual_gate(spark, sf_dir):
    """A residual fitted on the training subjects' pairs, its accuracy on each part beside the baseline's, and whether it may take over."""
    f = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("event_id"), c("l_linenumber").cast("string").alias("id")).agg((F.max("l_quantity") / 50).alias("size"), (F.max("l_discount") * 10).alias("cut"), (0.05 + 0.9 * F.max("l_tax") / 0.08).alias("score"))
    # An event's features as one map (of what it showed), which its pairs meet once: events are dealt once for all of it.
    f = f.where("id IS NOT NULL").repartition("event_id").groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("size", "cut", "score")))).alias("of"))
    q = pairs.build_pairs(shown(spark, sf_dir)).join(f, "event_id").withColumns({"winner": c("of")[c("winner_id")], "loser": c("of")[c("loser_id")]})
    q = q.where("winner IS NOT NULL AND loser IS NOT NULL").select("subject", "weight", c("winner.score").alias("winner_score"), c("loser.score").alias("loser_score"), (c("winner.size") - c("loser.size")).alias("d_size"), (c("winner.cut") - c("loser.cut")).alias("d_cut"))
    # Written once: the fit and the comparison both read it.
    d = scratch.kept(q.join(pairs.split_subjects(table(spark, sf_dir, "orders").select(c("o_custkey").alias("subject"))), "subject"), "pairs")
    w = pairs.fit_pairs(d.where("part = 'train'"), ["size", "cut"])
    base = scores.logit(c("winner_score")) - scores.logit(c("loser_score"))
    pull = c("d_size") * w["size"] + c("d_cut") * w["cut"]
    new = base + 0.5 * F.greatest(F.lit(-0.75), F.least(F.lit(0.75), pull))
    told = d.groupBy("part").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("subject").alias("subjects"), F.round(pairs.weighted_accuracy(base > 0, c("weight")), 6).alias("baseline"), F.round(pairs.weighted_accuracy(new > 0, c("weight")), 6).alias("fitted"))
    enough = (c("subjects") >= 25) & (c("pairs") >= 200) & (c("fitted") - c("baseline") >= 0.02)
    return told.withColumns({"size": F.lit(round(w["size"], 6)), "cut": F.lit(round(w["cut"], 6)), "activates": (c("part") == "test") & enough})
