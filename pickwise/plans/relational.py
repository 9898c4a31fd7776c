"""Queries over subjects (`customer`), their runs (`orders`) and the runs' parts (`lineitem`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranks
from ..operators import relational as rel
from ..sources.tables import table
from .registry import query

c = F.col


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def n_rows() -> F.Column:
    return F.count(F.lit(1))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1")
def latest_run_per_subject(spark, sf_dir):
    """The latest runs of each subject; runs of one moment are all kept."""
    (o,) = load(spark, sf_dir, "orders")
    return rel.latest(o, ["o_custkey"], [c("o_orderdate").desc()], ties=True).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_run_one(spark, sf_dir):
    """One latest run of each subject."""
    (o,) = load(spark, sf_dir, "orders")
    return rel.latest(o, ["o_custkey"], [c("o_orderdate").desc(), c("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders o JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND c_acctbal > 0
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def review_queue(spark, sf_dir):
    """The latest pending run (not the latest run) of each present subject."""
    o, s = load(spark, sf_dir, "orders", "customer")
    j = o.where(c("o_orderstatus") == "O").join(s.where(c("c_acctbal") > 0), c("o_custkey") == c("c_custkey"))
    return rel.latest(j, ["o_custkey"], [c("o_orderdate").desc(), c("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer")
def review_pending_flag(spark, sf_dir):
    s, o = load(spark, sf_dir, "customer", "orders")
    flags = o.where(c("o_orderstatus") == "P").select(c("o_custkey").alias("c_custkey")).distinct().withColumn("p", F.lit(True))
    return s.join(flags, "c_custkey", "left").select("c_custkey", F.coalesce("p", F.lit(False)).alias("pending"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND (o_totalprice > 300000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45))""")
def downloaded_or_has_file(spark, sf_dir):
    """Present rows that have a path of their own or a live file: EXISTS inside OR."""
    o, f = load(spark, sf_dir, "orders", "lineitem")
    return spark.sql("SELECT o_orderkey FROM {runs} WHERE o_orderstatus <> 'P' AND (o_totalprice > 300000 OR EXISTS (SELECT 1 FROM {files} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45))", runs=o, files=f)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def no_active_work(spark, sf_dir):
    s, o = load(spark, sf_dir, "customer", "orders")
    return rel.missing(s, o.where(c("o_orderstatus") == "O").select(c("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN s_acctbal > 5000 THEN s_nationkey END FROM supplier)")
def not_in_null_trap(spark, sf_dir):
    """NOT IN over a column with nulls: never true while one null is in it."""
    n, s = load(spark, sf_dir, "nation", "supplier")
    return spark.sql("SELECT n_nationkey, n_name FROM {nations} WHERE n_nationkey NOT IN (SELECT CASE WHEN s_acctbal > 5000 THEN s_nationkey END FROM {suppliers})", nations=n, suppliers=s)


@query("""SELECT n_nationkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS review FROM nation""")
def review_by_either(spark, sf_dir):
    """Two correlations joined by OR, as the union of both key sets."""
    n, s, p = load(spark, sf_dir, "nation", "customer", "supplier")
    keys = s.where(c("c_acctbal") > 9900).select(c("c_nationkey").alias("k")).union(p.where(c("s_acctbal") > 9000).select("s_nationkey")).distinct().withColumn("hit", F.lit(True))
    return n.join(keys, c("n_nationkey") == c("k"), "left").select("n_nationkey", F.coalesce("hit", F.lit(False)).alias("review"))


@query("""WITH hit AS (SELECT o_orderkey AS k, o_custkey AS parent FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 350000)
SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT k FROM hit) OR o_custkey IN (SELECT parent FROM hit)""")
def related_match(spark, sf_dir):
    """Jobs that match themselves or whose siblings do."""
    (o,) = load(spark, sf_dir, "orders")
    hit = o.where((c("o_orderpriority") == "1-URGENT") & (c("o_totalprice") > 350000))
    own = hit.select("o_orderkey")
    siblings = o.join(hit.select("o_custkey").distinct(), "o_custkey", "left_semi").select("o_orderkey")
    return own.union(siblings).distinct()


@query("""SELECT l_orderkey, count(*) AS children, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_linestatus = 'O') AS open,
  count(*) FILTER (WHERE l_discount > 0.05) AS discounted, max(l_shipdate) AS last_ship, coalesce(max(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS most_returned FROM lineitem GROUP BY l_orderkey""")
def parent_outcome_rollup(spark, sf_dir):
    (f,) = load(spark, sf_dir, "lineitem")
    return f.groupBy("l_orderkey").agg(n_rows().alias("children"), F.count_if(c("l_returnflag") == "R").alias("returned"), F.count_if(c("l_linestatus") == "O").alias("open"), F.count_if(c("l_discount") > 0.05).alias("discounted"), F.max("l_shipdate").alias("last_ship"), F.coalesce(F.max(F.when(c("l_returnflag") == "R", c("l_quantity"))), F.lit(0.0)).alias("most_returned"))


@query("""SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS blocked, count(*) FILTER (WHERE o_orderstatus = 'O') AS waiting,
  count(*) FILTER (WHERE o_totalprice > 400000) AS large, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'O') AS subjects FROM orders""")
def attention_card(spark, sf_dir):
    (o,) = load(spark, sf_dir, "orders")
    s, p = c("o_orderstatus"), c("o_orderpriority")
    return o.agg(F.count_if(s == "P").alias("failed"), F.count_if((s == "O") & (p == "1-URGENT")).alias("blocked"), F.count_if(s == "O").alias("waiting"), F.count_if(c("o_totalprice") > 400000).alias("large"), F.count_distinct(F.when(s == "O", c("o_custkey"))).alias("subjects"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS jobs FROM orders GROUP BY ALL")
def phase_outcome_counts(spark, sf_dir):
    (o,) = load(spark, sf_dir, "orders")
    return o.groupBy("o_orderstatus", "o_orderpriority").agg(n_rows().alias("jobs"))


@query("""WITH d AS (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS v, avg(o_totalprice) AS a, max(o_totalprice) AS m, count(*) AS n, count(DISTINCT o_custkey) AS subjects FROM orders GROUP BY o_orderpriority)
SELECT o_orderpriority, n AS runs, subjects, round(a, 4) AS mean, m AS longest, v[1 + least(n - 1, CAST(floor(n * 0.5) AS BIGINT))] AS p50, v[1 + least(n - 1, CAST(floor(n * 0.9) AS BIGINT))] AS p90 FROM d""")
def run_metrics_nearest_rank(spark, sf_dir):
    """Mean, longest and nearest-rank p50 and p90: the value at place min(n - 1, int(n * p)) in order.

    Places are found by counts of value buckets, so no group's values are gathered or put in order as a whole.
    """
    (o,) = load(spark, sf_dir, "orders")
    g = o.groupBy("o_orderpriority").agg(n_rows().alias("runs"), F.count_distinct("o_custkey").alias("subjects"), F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("longest"))
    at = lambda p: F.least(c("_n") - 1, F.floor(c("_n") * p))
    q = ranks.at_ranks(o.select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", {"p50": at(0.5), "p90": at(0.9)})
    return g.join(q, "o_orderpriority").select("o_orderpriority", "runs", "subjects", F.round("mean", 4).alias("mean"), "longest", "p50", "p90")


@query("""SELECT n_nationkey, count(c_custkey) AS subjects, coalesce(bool_and(CASE WHEN c_acctbal > 0 THEN c_mktsegment <> 'FURNITURE' END), true) AS all_covered FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def all_children_covered(spark, sf_dir):
    """Whether all present children are covered; true where there are none."""
    n, s = load(spark, sf_dir, "nation", "customer")
    j = n.join(s, c("n_nationkey") == c("c_nationkey"), "left")
    return j.groupBy("n_nationkey").agg(F.count("c_custkey").alias("subjects"), F.coalesce(F.bool_and(F.when(c("c_acctbal") > 0, c("c_mktsegment") != "FURNITURE")), F.lit(True)).alias("all_covered"))


@query("""SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O' QUALIFY place <= 1000""")
def queue_rank(spark, sf_dir):
    """Places in each class's queue, the first 1000."""
    (o,) = load(spark, sf_dir, "orders")
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(c("o_totalprice").desc(), "o_orderdate", "o_orderkey")).cast("long")
    return o.where(c("o_orderstatus") == "O").select("o_orderkey", "o_orderpriority", place.alias("place")).where(c("place") <= 1000)


@query("""SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders WHERE o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND o_totalprice < 200000) OR (o_orderpriority = '2-HIGH' AND o_totalprice = 200000 AND o_orderkey > 7)
  ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 51""")
def keyset_page(spark, sf_dir):
    """The page of 50 behind a cursor in a mixed order, with one row to tell whether more follow."""
    (o,) = load(spark, sf_dir, "orders")
    return rel.page(o.select("o_orderpriority", "o_orderkey", "o_totalprice"), [("o_orderpriority", False), ("o_totalprice", True), ("o_orderkey", False)], ["2-HIGH", 200000.0, 7], 50)


@query("SELECT c_custkey, c_name, CAST(count(*) OVER () AS BIGINT) AS total FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_name, c_custkey LIMIT 25 OFFSET 50")
def offset_page(spark, sf_dir):
    """A page by offset with the count of all."""
    (s,) = load(spark, sf_dir, "customer")
    own = s.where(c("c_mktsegment") == "BUILDING")
    return own.orderBy("c_name", "c_custkey").offset(50).limit(25).crossJoin(F.broadcast(own.agg(n_rows().alias("total")))).select("c_custkey", "c_name", "total")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC NULLS LAST, o_orderkey) AS place FROM orders WHERE o_totalprice > 380000""")
def failure_first_order(spark, sf_dir):
    (o,) = load(spark, sf_dir, "orders")
    severity = F.when(c("o_orderstatus") == "P", 0).when(c("o_orderstatus") == "O", 1).otherwise(2)
    own = o.where(c("o_totalprice") > 380000).withColumns({"severity": severity, "month": F.coalesce(-F.unix_date(F.trunc("o_orderdate", "month")), F.lit(2**31 - 1))})
    placed = ranks.place(own, [], F.struct("severity", "month"), [c("o_orderdate").desc_nulls_last(), c("o_orderkey")])
    return placed.select("o_orderkey", (c("place") + 1).alias("place"))


@query("""SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= DATE '1997-01-01' AND l_quantity > 49""")
def bridge_distinct(spark, sf_dir):
    """Subjects reached over a bridge, each once."""
    s, o, f = load(spark, sf_dir, "customer", "orders", "lineitem")
    runs = o.join(f.where((c("l_shipdate") >= F.lit("1997-01-01").cast("date")) & (c("l_quantity") > 49)), c("o_orderkey") == c("l_orderkey"), "left_semi")
    return s.join(runs, c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("""SELECT n_name, list_sort(list(s_name)) AS suppliers, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""")
def nested_rollup(spark, sf_dir):
    """Children nested under their parents in order (a parent has a bounded number)."""
    n, s = load(spark, sf_dir, "nation", "supplier")
    kids = s.groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_name")).alias("suppliers"), n_rows().alias("n"))
    j = n.join(kids, c("n_nationkey") == c("s_nationkey"), "left")
    return j.select("n_name", F.coalesce("suppliers", F.array(F.lit(None).cast("string"))).alias("suppliers"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(a.p_name, b.s_name, 'none') AS found FROM lineitem LEFT JOIN part a ON a.p_partkey = l_partkey AND a.p_size > 25 LEFT JOIN supplier b ON b.s_suppkey = l_suppkey AND b.s_acctbal > 0""")
def cascading_lookup(spark, sf_dir):
    """The first of several lookups that has an answer."""
    f, p, s = load(spark, sf_dir, "lineitem", "part", "supplier")
    j = f.join(p.where(c("p_size") > 25), c("p_partkey") == c("l_partkey"), "left").join(s.where(c("s_acctbal") > 0), c("s_suppkey") == c("l_suppkey"), "left")
    return j.select("l_orderkey", "l_linenumber", F.coalesce("p_name", "s_name", F.lit("none")).alias("found"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersection(spark, sf_dir):
    s, p = load(spark, sf_dir, "customer", "supplier")
    return s.select(c("c_nationkey").alias("k")).intersect(p.where(c("s_acctbal") > 5000).select("s_nationkey"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def set_symmetric_diff(spark, sf_dir):
    (o,) = load(spark, sf_dir, "orders")
    k = o.select(c("o_custkey").alias("k"), "o_orderstatus")
    return rel.symmetric_difference(k.where(c("o_orderstatus") == "F"), k.where(c("o_orderstatus") == "P"), "k")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= DATE '1998-06-01')")
def stale_anti(spark, sf_dir):
    """Stored keys that the newest snapshot does not hold."""
    p, f = load(spark, sf_dir, "part", "lineitem")
    return rel.missing(p, f.where(c("l_shipdate") >= F.lit("1998-06-01").cast("date")).select(c("l_partkey").alias("p_partkey")), "p_partkey").select("p_partkey")


@query("SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_type, p_size) AS copies, count(*) OVER (PARTITION BY p_type, p_size) > 1 AS duplicated FROM part")
def duplicate_flags(spark, sf_dir):
    (p,) = load(spark, sf_dir, "part")
    n = F.count(F.lit(1)).over(Window.partitionBy("p_type", "p_size"))
    return p.select("p_partkey", "p_name", n.alias("copies"), (n > 1).alias("duplicated"))


@query("SELECT p_type, p_size, count(*) AS copies FROM part GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    (p,) = load(spark, sf_dir, "part")
    return p.groupBy("p_type", "p_size").agg(n_rows().alias("copies")).where(c("copies") > 1)


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS word FROM part) GROUP BY word")
def genre_style_explode(spark, sf_dir):
    """A histogram over a list column."""
    (p,) = load(spark, sf_dir, "part")
    return p.select(F.explode(F.split(F.lower("p_type"), " ")).alias("word")).groupBy("word").agg(n_rows().alias("n"))


@query("""SELECT count(*) FILTER (WHERE toxic = 0) AS positives, count(*) FILTER (WHERE toxic = 1) AS negatives, count(DISTINCT doc_id) AS subjects FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)""")
def label_stats_after_revocation(spark, sf_dir):
    """Labels counted without the revoked ones."""
    (l,) = load(spark, sf_dir, "labels")
    own = rel.missing(l, l.where((c("quality") == 0) & c("doc_id").isNotNull()), "doc_id")
    return own.agg(F.count_if(c("toxic") == 0).alias("positives"), F.count_if(c("toxic") == 1).alias("negatives"), F.count_distinct("doc_id").alias("subjects"))


@query("""WITH a AS (SELECT p_partkey AS id, p_name AS name, p_retailprice AS price, p_size % 2 = 0 AS present FROM part WHERE p_size > 10), b AS (SELECT p_partkey AS id, upper(p_name) AS name, p_retailprice + 1 AS price FROM part WHERE p_retailprice > 950)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NOT NULL THEN b.name ELSE a.name END AS name, round(CASE WHEN b.id IS NOT NULL THEN b.price ELSE a.price END, 2) AS price, b.id IS NOT NULL AS present,
  CASE WHEN b.id IS NOT NULL AND a.id IS NULL THEN 'added' WHEN b.id IS NOT NULL THEN 'updated' WHEN a.present THEN 'retired' ELSE 'kept' END AS change FROM a FULL JOIN b ON a.id = b.id""")
def sync_upsert(spark, sf_dir):
    """A snapshot merged into stored rows; unseen rows retire because the sync had no errors."""
    (p,) = load(spark, sf_dir, "part")
    stored = p.where("p_size > 10").select(c("p_partkey").alias("id"), c("p_name").alias("name"), c("p_retailprice").alias("price"), (c("p_size") % 2 == 0).alias("present"))
    seen = p.where("p_retailprice > 950").select(c("p_partkey").alias("id"), F.upper("p_name").alias("name"), (c("p_retailprice") + 1).alias("price"))
    return rel.upsert(stored, seen, "id").withColumn("price", F.round("price", 2))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1994-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > TIMESTAMP '1997-01-01') ORDER BY o_orderdate, o_orderkey LIMIT 101""")
def retention_eligible(spark, sf_dir):
    """Old ended jobs that nothing living depends on, the oldest 100 and one to tell of more."""
    o, f = load(spark, sf_dir, "orders", "lineitem")
    old = o.where((c("o_orderstatus") == "F") & (c("o_orderdate") < F.lit("1994-01-01").cast("timestamp_ntz")))
    for hold in (f.where(c("l_returnflag") == "R"), f.where(c("l_shipdate") > F.lit("1997-01-01").cast("timestamp_ntz"))):
        old = rel.missing(old, hold.select(c("l_orderkey").alias("o_orderkey")), "o_orderkey")
    return old.orderBy("o_orderdate", "o_orderkey").limit(101).select("o_orderkey")


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'review' WHEN c_acctbal > 5000 THEN 'deployed' WHEN c_acctbal > 0 THEN 'approved' ELSE 'missing' END AS status FROM customer""")
def artwork_status(spark, sf_dir):
    """The first status that fits: review, deployed, approved, missing."""
    s, o = load(spark, sf_dir, "customer", "orders")
    p = o.where(c("o_orderstatus") == "P").select(c("o_custkey").alias("k")).distinct()
    j = s.join(p, c("c_custkey") == c("k"), "left")
    return j.select("c_custkey", F.when(c("k").isNotNull(), "review").when(c("c_acctbal") > 5000, "deployed").when(c("c_acctbal") > 0, "approved").otherwise("missing").alias("status"))


@query("""WITH s AS (SELECT DISTINCT c_mktsegment AS segment, c_nationkey FROM customer), need AS (SELECT DISTINCT s_nationkey FROM supplier)
SELECT segment, list_sort(list(s_nationkey)) AS uncovered FROM (SELECT m.segment, need.s_nationkey FROM (SELECT DISTINCT segment FROM s) m CROSS JOIN need EXCEPT SELECT segment, c_nationkey FROM s) GROUP BY segment""")
def required_minus_capable(spark, sf_dir):
    """Which required entries each worker class does not cover."""
    s, p = load(spark, sf_dir, "customer", "supplier")
    need = p.agg(F.array_sort(F.collect_set("s_nationkey")).alias("need"))  # as many as there are nations
    have = s.groupBy(c("c_mktsegment").alias("segment")).agg(F.collect_set("c_nationkey").alias("have"))
    left = have.crossJoin(F.broadcast(need)).select("segment", F.array_except("need", "have").alias("uncovered"))
    return left.where(F.size("uncovered") > 0)


@query("""WITH f AS (SELECT o_orderkey, o_custkey, o_orderstatus, count(*) OVER (PARTITION BY o_custkey) AS members, count(*) FILTER (WHERE o_orderstatus = 'P') OVER (PARTITION BY o_custkey) AS failed FROM orders)
SELECT o_custkey, o_orderkey FROM f WHERE o_orderstatus = 'P' AND members >= 3 AND failed < members""")
def retryable_children(spark, sf_dir):
    """Failed members of batches of three or more that did not fail as a whole."""
    (o,) = load(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey")
    f = o.withColumns({"members": F.count(F.lit(1)).over(w), "failed": F.count_if(c("o_orderstatus") == "P").over(w)})
    return f.where((c("o_orderstatus") == "P") & (c("members") >= 3) & (c("failed") < c("members"))).select("o_custkey", "o_orderkey")


@query("""WITH u AS (SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'part', p_partkey, NULL FROM part WHERE p_size < 3)
SELECT kind, id, n_name IS NOT NULL AS placed FROM u LEFT JOIN nation ON n_nationkey = n""")
def heal_discovery(spark, sf_dir):
    """Rows of three tables that want mending, split by whether their place exists."""
    s, p, parts, n = load(spark, sf_dir, "customer", "supplier", "part", "nation")
    rows = s.where(c("c_acctbal") < 0).select(F.lit("customer").alias("kind"), c("c_custkey").alias("id"), c("c_nationkey").alias("n"))
    rows = rows.unionByName(p.where(c("s_acctbal") < 0).select(F.lit("supplier").alias("kind"), c("s_suppkey").alias("id"), c("s_nationkey").alias("n")))
    rows = rows.unionByName(parts.where(c("p_size") < 3).select(F.lit("part").alias("kind"), c("p_partkey").alias("id"), F.lit(None).cast("int").alias("n")))
    return rows.join(n, c("n") == c("n_nationkey"), "left").select("kind", "id", c("n_name").isNotNull().alias("placed"))


@query("""WITH r AS (SELECT c_nationkey, count(DISTINCT c_custkey) AS subjects, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_totalprice > 450000) AS failed, bool_or(o_totalprice > 499000) AS ready FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey)
SELECT c_nationkey, subjects, CASE WHEN ready THEN 'personalized' WHEN subjects >= 50 AND open > 200 THEN 'building' WHEN subjects >= 50 AND failed > 10 THEN 'degraded' WHEN subjects >= 50 THEN 'eligible' ELSE 'collecting' END AS state FROM r""")
def readiness(spark, sf_dir):
    """A namespace's state, by precedence: ready, or with fifty subjects building, degraded or eligible, else collecting."""
    s, o = load(spark, sf_dir, "customer", "orders")
    status, price = c("o_orderstatus"), c("o_totalprice")
    r = s.join(o, c("o_custkey") == c("c_custkey"), "left").groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("subjects"), F.count_if(status == "O").alias("open"), F.count_if((status == "P") & (price > 450000)).alias("failed"), F.bool_or(price > 499000).alias("ready"))
    enough = c("subjects") >= 50
    state = F.when(c("ready"), "personalized").when(enough & (c("open") > 200), "building").when(enough & (c("failed") > 10), "degraded").when(enough, "eligible").otherwise("collecting")
    return r.select("c_nationkey", "subjects", state.alias("state"))


@query("SELECT c_custkey FROM customer WHERE c_name ILIKE '%er#00000_12%' OR c_name LIKE '%#0000003%'")
def ilike_search(spark, sf_dir):
    """A search with signs taken as patterns, case aside, beside one with signs escaped."""
    from ..functions.texts import escape_like

    (s,) = load(spark, sf_dir, "customer")
    return s.where(c("c_name").ilike("%ER#00000_12%") | c("c_name").like(f"%{escape_like('#0000003')}%")).select("c_custkey")


@query("""SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_acctbal > 0 ORDER BY c_custkey""")
def run_queue(spark, sf_dir):
    """Subjects with a file and neither a review nor a poster yet."""
    s, o = load(spark, sf_dir, "customer", "orders")
    key = o.select(c("o_custkey").alias("c_custkey"), "o_orderstatus")
    have = s.where(c("c_acctbal") > 0).join(key.where(c("o_orderstatus") == "O"), "c_custkey", "left_semi")
    return rel.missing(have, key.where(c("o_orderstatus") == "P"), "c_custkey").orderBy("c_custkey").select("c_custkey")


@query("""WITH k AS (SELECT o_custkey, min(o_orderkey) AS first_key FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
SELECT o.o_orderkey AS asked, k.first_key AS active FROM orders o JOIN k ON k.o_custkey = o.o_custkey WHERE o.o_orderstatus = 'O' AND k.first_key < o.o_orderkey""")
def active_overlap(spark, sf_dir):
    """For each request, the oldest active one of its subject, where that is another."""
    (o,) = load(spark, sf_dir, "orders")
    own = o.where(c("o_orderstatus") == "O").withColumn("active", F.min("o_orderkey").over(Window.partitionBy("o_custkey")))
    return own.where(c("active") < c("o_orderkey")).select(c("o_orderkey").alias("asked"), "active")
