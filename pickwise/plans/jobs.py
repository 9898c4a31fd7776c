"""Queries over jobs, their batches and members, and over the runs they made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import jobs as op
from ..operators import relational as rel
from ..sources.tables import table
from .entities import entity, sql
from .registry import query

c = F.col
NOW = "1998-06-01"


def at(day: str = NOW) -> F.Column:
    return F.lit(day).cast("timestamp_ntz")


def members(spark, sf_dir: str) -> DataFrame:
    """job_id, subject: the members of groups are their orders' parts."""
    f = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 = 1")
    return f.select(c("l_orderkey").alias("job_id"), c("l_partkey").alias("subject"))


@query(f"""{sql("jobs")}, kids AS (SELECT *, coalesce(type = 'group' AND outcome = 'partially_succeeded' AND failed_count = 0, false) AS review FROM jobs WHERE parent_id IS NOT NULL),
s AS (SELECT parent_id, count(*) AS n, count(*) FILTER (WHERE outcome IS NOT NULL) AS ended, count(*) FILTER (WHERE phase IN ('running', 'stopping', 'terminal')) AS begun, count(*) FILTER (WHERE review) AS rv,
  count(*) FILTER (WHERE outcome = 'succeeded') AS ok, count(*) FILTER (WHERE outcome = 'no_change') AS same, count(*) FILTER (WHERE outcome = 'partially_succeeded') AS part, count(*) FILTER (WHERE outcome IN ('failed', 'dead_letter', 'unsafe')) AS bad,
  count(*) FILTER (WHERE outcome = 'unsafe') AS unsafe, count(*) FILTER (WHERE outcome = 'cancelled') AS can, count(*) FILTER (WHERE outcome = 'superseded') AS sup,
  count(*) FILTER (WHERE outcome IN ('failed', 'partially_succeeded', 'dead_letter', 'unsafe') AND NOT review) AS att FROM kids GROUP BY parent_id),
p AS (SELECT job_id, sealed, cancel_wanted, coalesce(n, 0) AS n, coalesce(ended, 0) AS ended, coalesce(begun, 0) AS begun, coalesce(rv, 0) AS rv, coalesce(ok, 0) AS ok, coalesce(same, 0) AS same, coalesce(part, 0) AS part, coalesce(bad, 0) AS bad,
  coalesce(unsafe, 0) AS unsafe, coalesce(can, 0) AS can, coalesce(sup, 0) AS sup, coalesce(att, 0) AS att FROM jobs LEFT JOIN s ON s.parent_id = job_id WHERE jobs.parent_id IS NULL)
SELECT job_id, n AS children, ended, CASE WHEN sealed AND ended = n THEN 'terminal' WHEN cancel_wanted THEN 'stopping' WHEN begun > 0 THEN 'running' ELSE 'queued' END AS phase,
  CASE WHEN sealed AND ended = n THEN CASE WHEN part - rv > 0 THEN 'partially_succeeded'
    WHEN ok + same + rv > 0 AND bad + can + sup > 0 THEN 'partially_succeeded' WHEN ok + rv > 0 THEN 'succeeded' WHEN same > 0 THEN 'no_change'
    WHEN unsafe > 0 THEN 'unsafe' WHEN bad > 0 THEN 'failed' WHEN can > 0 THEN 'cancelled' WHEN sup > 0 THEN 'superseded' ELSE 'no_change' END END AS outcome,
  CASE WHEN att > 0 THEN CASE WHEN unsafe > 0 THEN 'error' ELSE 'warning' END END AS attention_level, att AS attention FROM p""")
def batch_outcome(spark, sf_dir):
    """Where each batch stands and what it came to, by its children's outcomes."""
    j = entity(spark, sf_dir, "jobs")
    return op.batch_projection(j.where("parent_id IS NULL"), j)


@query("""WITH i AS (SELECT l_orderkey, CASE l_linenumber % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'no_change' WHEN 4 THEN 'review_required' WHEN 5 THEN 'failed' ELSE 'cancelled' END AS state FROM lineitem)
SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'running') AS running, count(*) FILTER (WHERE state = 'succeeded') AS succeeded, count(*) FILTER (WHERE state = 'no_change') AS no_change,
  count(*) FILTER (WHERE state = 'review_required') AS review_required, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'cancelled') AS cancelled FROM i GROUP BY l_orderkey""")
def work_item_counts(spark, sf_dir):
    """A job's items by state, with zeros."""
    states = F.array(*[F.lit(s) for s in op.WORK_ITEM_STATES])
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", F.element_at(states, (c("l_linenumber") % 7 + 1).cast("int")).alias("state"))
    return op.state_counts(i, "l_orderkey", "state", op.WORK_ITEM_STATES)


@query(f"""{sql("jobs")} SELECT job_id, priority, phase FROM jobs WHERE phase <> 'terminal'
  ORDER BY CASE level WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END DESC, CASE WHEN phase IN ('running', 'stopping') THEN 0 ELSE 1 END, priority DESC, eligible_at, created_at, job_id LIMIT 200""")
def job_queue_order(spark, sf_dir):
    """The head of the queue in its order of six keys."""
    return op.ordered(entity(spark, sf_dir, "jobs").where("phase <> 'terminal'"), op.queue_keys()).limit(200).select("job_id", "priority", "phase")


@query(f"{sql('jobs')} SELECT job_id, outcome FROM jobs WHERE phase = 'terminal' ORDER BY terminal_at DESC, job_id DESC LIMIT 200")
def job_history_order(spark, sf_dir):
    """The jobs that ended last."""
    return op.ordered(entity(spark, sf_dir, "jobs").where("phase = 'terminal'"), op.history_keys()).limit(200).select("job_id", "outcome")


@query(f"{sql('jobs')} SELECT job_id, created_at FROM jobs WHERE phase = 'terminal' AND (created_at < TIMESTAMP '1999-01-01' OR (created_at = TIMESTAMP '1999-01-01' AND job_id < 5000)) ORDER BY created_at DESC, job_id DESC LIMIT 51")
def job_cursor_page(spark, sf_dir):
    """The page behind a cursor that went out to a client as an opaque token and came back."""
    of = op.contract("history", {"phase": "terminal", "worker": None}, "-created")
    day, job = op.decode_cursor(op.encode_cursor(of, ["1999-01-01 00:00:00", 5000]), of)
    j = entity(spark, sf_dir, "jobs").where("phase = 'terminal'").withColumn("day", c("created_at").cast("string"))
    return rel.page(j, [("day", True), ("job_id", True)], [day, job], 50).select("job_id", "created_at")


@query("SELECT DISTINCT l_orderkey AS job_id FROM lineitem WHERE l_partkey % 100 = 7 AND l_suppkey % 2 = 0")
def member_containment(spark, sf_dir):
    """Jobs among whose nested members one holds all of a fragment's fields."""
    f = table(spark, sf_dir, "lineitem")
    m = f.groupBy(c("l_orderkey").alias("job_id")).agg(F.collect_list(F.struct((c("l_partkey") % 100).alias("part"), F.when(c("l_suppkey") % 2 == 0, "series").otherwise("movie").alias("kind"))).alias("members"))
    return m.where(F.exists("members", lambda x: (x["part"] == 7) & (x["kind"] == "series"))).select("job_id")


@query(f"""{sql("jobs")} SELECT job_id FROM jobs j WHERE NOT (
  (type = 'batch' AND EXISTS (SELECT 1 FROM jobs k WHERE k.parent_id = j.job_id AND k.type IN ('group', 'item'))) OR (type = 'heal' AND EXISTS (SELECT 1 FROM jobs k WHERE k.parent_id = j.job_id AND k.type = 'group'))
  OR (type = 'item' AND EXISTS (SELECT 1 FROM jobs p WHERE p.job_id = j.parent_id AND p.type = 'tv_batch')))""")
def activity_visible(spark, sf_dir):
    """Jobs that a list of activities shows: no parents whose children stand for them, no children hidden below theirs."""
    return op.visible(entity(spark, sf_dir, "jobs"), {"batch": ["group", "item"], "heal": ["group"]}, {"tv_batch": ["item"]}).select("job_id")


@query(f"{sql('jobs')} SELECT job_id FROM jobs WHERE created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '1997-02-01'")
def jobs_in_range(spark, sf_dir):
    """Jobs of a half-open range of time, so that neighbouring ranges share none."""
    return entity(spark, sf_dir, "jobs").where((c("created_at") >= at("1997-01-01")) & (c("created_at") < at("1997-02-01"))).select("job_id")


@query(f"""{sql("jobs")}, own AS (SELECT j.* FROM jobs j LEFT JOIN jobs p ON p.job_id = j.parent_id WHERE j.type IN ('item', 'group') AND (j.phase <> 'terminal' OR (p.type = 'batch' AND p.phase <> 'terminal')))
SELECT subject FROM own WHERE type = 'item' UNION SELECT l_partkey FROM own JOIN lineitem ON l_orderkey = job_id WHERE type = 'group'""")
def active_subjects(spark, sf_dir):
    """Subjects that active single or grouped work covers, also through an active parent."""
    return op.active_members(entity(spark, sf_dir, "jobs"), members(spark, sf_dir), "batch")


@query(f"""{sql("jobs")} SELECT job_id, l_linenumber AS attempt FROM jobs JOIN lineitem ON l_orderkey = job_id LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0
  WHERE phase IN ('running', 'stopping') AND l_returnflag <> 'N' AND (s_suppkey IS NULL OR s_acctbal < 3000) ORDER BY job_id, attempt LIMIT 100""")
def orphan_attempts(spark, sf_dir):
    """The first attempts of running jobs whose worker is unknown or gone."""
    j, a, w = entity(spark, sf_dir, "jobs"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    own = j.where(c("phase").isin("running", "stopping")).join(a.where("l_returnflag <> 'N'"), c("l_orderkey") == c("job_id"))
    own = own.join(w.where("s_acctbal > 0"), c("s_suppkey") == c("l_suppkey"), "left").where("s_suppkey IS NULL OR s_acctbal < 3000")
    return own.select("job_id", c("l_linenumber").alias("attempt")).orderBy("job_id", "attempt").limit(100)


RETENTION = "SELECT count(*) AS overdue, min(o_orderdate + INTERVAL 90 DAY) AS oldest FROM orders WHERE o_orderstatus = 'F' AND o_orderdate + INTERVAL 90 DAY <= TIMESTAMP '1998-06-01'"


def overdue(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("expires_at", c("o_orderdate") + F.expr("INTERVAL 90 DAY"))
    return o.where((c("o_orderstatus") == "F") & (c("expires_at") <= at())).agg(F.count(F.lit(1)).alias("overdue"), F.min("expires_at").alias("oldest"))


@query(RETENTION)
def evidence_retention(spark, sf_dir):
    """How much evidence is past its time, and the oldest of it."""
    return overdue(spark, sf_dir)


@query(f"""{sql("jobs")}, k AS ({RETENTION}), q AS (SELECT count(*) FILTER (WHERE phase IN ('running', 'stopping')) AS active, count(*) FILTER (WHERE phase = 'queued') AS queued, count(*) FILTER (WHERE outcome = 'dead_letter') AS held,
  min(eligible_at) FILTER (WHERE phase = 'queued' AND eligible_at <= TIMESTAMP '1998-06-01') AS first_due FROM jobs)
SELECT active, queued, held, CAST(epoch(TIMESTAMP '1998-06-01') - epoch(first_due) AS BIGINT) AS oldest_age_seconds, overdue, oldest, overdue > 0 AS any_overdue FROM q, k""")
def operations_snapshot(spark, sf_dir):
    """One row on work under way, the queue's oldest entry and evidence past its time."""
    j = entity(spark, sf_dir, "jobs")
    q = j.agg(F.count_if(c("phase").isin("running", "stopping")).alias("active"), F.count_if(c("phase") == "queued").alias("queued"), F.count_if(c("outcome") == "dead_letter").alias("held"), F.min(F.when((c("phase") == "queued") & (c("eligible_at") <= at()), c("eligible_at"))).alias("first_due"))
    age = F.unix_seconds(at().cast("timestamp")) - F.unix_seconds(c("first_due").cast("timestamp"))
    return q.crossJoin(overdue(spark, sf_dir)).select("active", "queued", "held", age.alias("oldest_age_seconds"), "overdue", "oldest", (c("overdue") > 0).alias("any_overdue"))


@query(f"""{sql("movies", "runs")}, d AS (SELECT *, EXISTS (SELECT 1 FROM runs r WHERE r.movie_id = movies.movie_id AND media_type = 'movie' AND feedback IS NULL AND status IN ('completed', 'flagged_manual')) AS review,
  EXISTS (SELECT 1 FROM runs r WHERE r.movie_id = movies.movie_id AND status = 'running') AS active FROM movies WHERE is_present AND own_path IS NOT NULL),
l AS (SELECT r.* FROM runs r JOIN d ON d.movie_id = r.movie_id WHERE media_type = 'movie' QUALIFY rank() OVER (PARTITION BY r.movie_id ORDER BY started_at DESC) = 1)
SELECT count(*) AS total, count(poster_path) AS with_poster, count(*) - count(poster_path) AS without, count(*) FILTER (WHERE poster_path IS NULL AND NOT review AND NOT active) AS awaiting_run,
  count(*) FILTER (WHERE review) AS in_review, (SELECT count(*) FROM l WHERE status = 'running') AS in_run FROM d""")
def pipeline_summary(spark, sf_dir):
    """Six counts on the library and its runs, each in one pass."""
    r = entity(spark, sf_dir, "runs")
    d = entity(spark, sf_dir, "movies").where("is_present AND own_path IS NOT NULL")
    flags = r.groupBy("movie_id").agg(F.bool_or((c("media_type") == "movie") & c("feedback").isNull() & c("status").isin("completed", "flagged_manual")).alias("review"), F.bool_or(c("status") == "running").alias("active"))
    d = d.join(flags, "movie_id", "left").na.fill(False, ["review", "active"])
    film = r.where("media_type = 'movie'").join(d.select("movie_id"), "movie_id", "left_semi")
    running = rel.latest(film, ["movie_id"], [c("started_at").desc()], ties=True).agg(F.count_if(c("status") == "running").alias("in_run"))
    s = d.agg(F.count(F.lit(1)).alias("total"), F.count("poster_path").alias("with_poster"), (F.count(F.lit(1)) - F.count("poster_path")).alias("without"), F.count_if(c("poster_path").isNull() & ~c("review") & ~c("active")).alias("awaiting_run"), F.count_if("review").alias("in_review"))
    return s.crossJoin(running)


@query(f"""{sql("jobs", "runs")}, b AS (SELECT job_id, CASE outcome WHEN 'failed' THEN 'failed' WHEN 'dead_letter' THEN 'failed' WHEN 'cancelled' THEN 'cancelled' END AS new, terminal_at, outcome FROM jobs WHERE phase = 'terminal'),
j AS (SELECT runs.*, b.*, coalesce(status = 'running' AND new IS NOT NULL, false) AS stale FROM runs LEFT JOIN b ON b.job_id = batch_id)
SELECT run_id, CASE WHEN stale THEN new ELSE status END AS status, CASE WHEN stale THEN coalesce(completed_at, terminal_at, TIMESTAMP '1998-06-01') ELSE completed_at END AS completed_at, CASE WHEN stale THEN coalesce(error, outcome) ELSE error END AS error, stale AS repaired FROM j""")
def stale_run_repair(spark, sf_dir):
    """Runs that their ended batch left running, put right."""
    return op.repair_runs(entity(spark, sf_dir, "runs"), entity(spark, sf_dir, "jobs"), NOW)


@query(f"""{sql("jobs")}, m AS (SELECT DISTINCT l_orderkey AS job_id, l_partkey AS member FROM lineitem), r AS (SELECT job_id, member, CASE WHEN member % 3 = 0 THEN 'failed' ELSE 'completed' END AS status FROM m WHERE job_id % 8 = 1 AND member % 29 <> 0),
n AS (SELECT job_id, count(*) AS n FROM m GROUP BY job_id), k AS (SELECT job_id, count(*) AS n FROM r GROUP BY job_id)
SELECT job_id, member FROM jobs JOIN n USING (job_id) JOIN k USING (job_id) JOIN r USING (job_id) WHERE type = 'group' AND outcome = 'partially_succeeded' AND n.n = k.n AND r.status = 'failed'
UNION ALL SELECT job_id, member FROM jobs JOIN m USING (job_id) WHERE type = 'group' AND outcome IN ('failed', 'cancelled') AND job_id NOT IN (SELECT job_id FROM k)""")
def retryable_members(spark, sf_dir):
    """Members that a retry of each ended group takes up again, if its rows tell of all or of none."""
    m = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("job_id"), c("l_partkey").alias("member")).distinct()
    rows = m.where("job_id % 8 = 1 AND member % 29 <> 0").withColumn("status", F.when(c("member") % 3 == 0, "failed").otherwise("completed"))
    return op.retryable(entity(spark, sf_dir, "jobs").where("type = 'group'"), m, rows)


@query(f"""{sql("movies", "series", "seasons")}, m AS (SELECT l_orderkey AS job_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS place, CASE l_linenumber % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'series' ELSE 'season' END AS kind,
  CASE l_linenumber % 3 WHEN 0 THEN l_partkey ELSE CASE l_linenumber % 3 WHEN 1 THEN l_suppkey * 3 ELSE l_partkey END END AS subject_id FROM lineitem)
SELECT job_id, place, kind, subject_id, CASE kind WHEN 'movie' THEN (SELECT title FROM movies WHERE movie_id = subject_id) WHEN 'series' THEN (SELECT title FROM series WHERE series_id = subject_id)
  ELSE (SELECT series.title FROM seasons JOIN series ON series.series_id = seasons.series_id WHERE season_id = subject_id) END AS title FROM m""")
def group_snapshot(spark, sf_dir):
    """Each group's members in the order asked for, with what they are called."""
    f = table(spark, sf_dir, "lineitem")
    kind = F.when(c("l_linenumber") % 3 == 0, "movie").when(c("l_linenumber") % 3 == 1, "series").otherwise("season")
    member = F.struct("l_linenumber", "l_partkey", "l_suppkey", kind.alias("kind"), F.when(c("l_linenumber") % 3 == 1, c("l_suppkey") * 3).otherwise(c("l_partkey")).alias("id"))
    asked = f.groupBy(c("l_orderkey").alias("job_id")).agg(F.transform(F.sort_array(F.collect_list(member)), lambda x: F.struct(x["kind"].alias("kind"), x["id"].alias("id"))).alias("asked"))
    return op.group_snapshot(asked, *(entity(spark, sf_dir, n) for n in ("movies", "series", "seasons")))


@query("""WITH a AS (SELECT o_orderkey AS artifact, CASE WHEN o_orderstatus = 'F' THEN 'available' ELSE 'expired' END AS status, o_orderdate + INTERVAL 90 DAY AS expires_at FROM orders),
d AS (SELECT artifact FROM a WHERE status = 'available' AND expires_at <= TIMESTAMP '1998-06-01' ORDER BY artifact LIMIT 50)
SELECT artifact, CASE WHEN artifact IN (SELECT artifact FROM d) THEN 'expiring' ELSE status END AS status, artifact IN (SELECT artifact FROM d) AS claimed FROM a""")
def expired_artifacts(spark, sf_dir):
    """The next artifacts past their time are claimed; all others stay as they are."""
    o = table(spark, sf_dir, "orders")
    a = o.select(c("o_orderkey").alias("artifact"), F.when(c("o_orderstatus") == "F", "available").otherwise("expired").alias("status"), (c("o_orderdate") + F.expr("INTERVAL 90 DAY")).alias("expires_at"))
    return op.claim(a, (c("status") == "available") & (c("expires_at") <= at()), "artifact", "expiring").select("artifact", "status", "claimed")


@query(f"""{sql("jobs")} SELECT job_id, l_linenumber AS log FROM lineitem JOIN jobs ON l_orderkey = job_id WHERE l_returnflag IN ('A', 'R') AND worker = 3 AND phase = 'terminal' ORDER BY job_id, log LIMIT 50""")
def abandoned_logs(spark, sf_dir):
    """A worker's unsealed logs of ended attempts, the first of them."""
    logs = table(spark, sf_dir, "lineitem").where(c("l_returnflag").isin("A", "R"))
    j = logs.join(entity(spark, sf_dir, "jobs").where("worker = 3 AND phase = 'terminal'"), c("l_orderkey") == c("job_id"))
    return j.select("job_id", c("l_linenumber").alias("log")).orderBy("job_id", "log").limit(50)


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber - 1 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 30 END AS wait FROM lineitem")
def deferral_delay(spark, sf_dir):
    """How long each further deferral waits, until there is none."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", op.deferral_seconds(c("l_linenumber") - 1).alias("wait"))


@query(f"""{sql("jobs")}, h AS (SELECT * FROM jobs WHERE type = 'heal' AND phase = 'terminal' ORDER BY terminal_at DESC, job_id LIMIT 1)
SELECT job_id, terminal_at AS last_run, selection + subject % 7 AS checked, (SELECT count(*) FROM jobs k WHERE k.parent_id = h.job_id AND k.outcome = 'succeeded') AS restored,
  (SELECT count(*) FROM jobs k WHERE k.parent_id = h.job_id AND k.outcome IN ('failed', 'dead_letter', 'unsafe')) AS failed FROM h""")
def last_heal(spark, sf_dir):
    """The heal batch that ended last, and what its children came to."""
    j = entity(spark, sf_dir, "jobs")
    last = j.where("type = 'heal' AND phase = 'terminal'").orderBy(c("terminal_at").desc(), "job_id").limit(1)
    kids = j.select(c("parent_id").alias("p"), c("outcome").alias("o"))
    out = last.join(kids, c("job_id") == c("p"), "left").groupBy("job_id", c("terminal_at").alias("last_run"), (c("selection") + c("subject") % 7).alias("checked"))
    return out.agg(F.count_if(c("o") == "succeeded").alias("restored"), F.count_if(c("o").isin("failed", "dead_letter", "unsafe")).alias("failed"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01')")
def batched_delete(spark, sf_dir):
    """Old ended jobs deleted by a plan whose checksum still holds."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    due = (c("o_orderstatus") == "F") & (c("o_orderdate") < at("1996-01-01"))
    checksum = op.delete_planned(o, due, "o_orderkey", dry_run=True)[1].first()["checksum"]
    return op.delete_planned(o, due, "o_orderkey", checksum)[0].select("o_orderkey", "o_orderstatus")


@query("""WITH s AS (SELECT o_custkey AS key, o_orderkey AS id FROM orders WHERE o_orderkey % 10 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
n AS (SELECT o_custkey AS key, o_orderkey AS id FROM orders WHERE o_orderkey % 10 = 3 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
SELECT * FROM s UNION ALL SELECT * FROM n WHERE key NOT IN (SELECT key FROM s)""")
def insert_once(spark, sf_dir):
    """Events whose key is stored already, or comes twice, are not added again."""
    o = table(spark, sf_dir, "orders").select(c("o_custkey").alias("key"), c("o_orderkey").alias("id"))
    stored = rel.latest(o.where("id % 10 = 0"), ["key"], [c("id")])
    return op.insert_once(stored, o.where("id % 10 = 3"), "key", "id")


BRIDGE = """WITH l AS (SELECT DISTINCT l_orderkey AS episode_id, l_partkey AS file_id FROM lineitem WHERE l_linenumber <= 2), s AS (SELECT DISTINCT l_orderkey AS episode_id, l_partkey AS file_id FROM lineitem WHERE l_linenumber = 2 AND l_orderkey % 3 = 0),
a AS (SELECT * FROM l WHERE episode_id NOT IN (SELECT episode_id FROM s) UNION SELECT * FROM s)"""


def bridge(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("episode_id"), c("l_partkey").alias("file_id"), "l_linenumber")
    links, seen = (x.select("episode_id", "file_id").distinct() for x in (f.where("l_linenumber <= 2"), f.where("l_linenumber = 2 AND episode_id % 3 = 0")))
    files = table(spark, sf_dir, "part").select(c("p_partkey").alias("file_id"), (c("p_size") > 5).alias("active"))
    return op.relink(links, seen, files)


@query(f"{BRIDGE} SELECT * FROM a")
def bridge_links(spark, sf_dir):
    """Episodes' files after a sync that saw some of them."""
    return bridge(spark, sf_dir)[0]


@query(f"""{BRIDGE} SELECT p_partkey AS file_id, CASE WHEN p_partkey IN (SELECT file_id FROM s) THEN true
  WHEN p_partkey IN (SELECT file_id FROM (SELECT * FROM l EXCEPT SELECT * FROM a)) AND p_partkey NOT IN (SELECT file_id FROM a) THEN false ELSE p_size > 5 END AS active FROM part""")
def bridge_files(spark, sf_dir):
    """Files that lost their last link are retired."""
    return bridge(spark, sf_dir)[1]


@query(f"""{sql("jobs")}, h AS (SELECT * FROM jobs WHERE worker = 2 AND level = 'error') SELECT job_id FROM jobs j WHERE EXISTS (SELECT 1 FROM h WHERE h.job_id = j.job_id OR h.job_id = j.parent_id OR h.parent_id = j.job_id)""")
def related_jobs(spark, sf_dir):
    """Jobs that match themselves or through a parent or a child."""
    return op.related(entity(spark, sf_dir, "jobs"), (c("worker") == 2) & (c("level") == "error")).select("job_id")


@query(f"""{sql("jobs")}, k AS (SELECT parent_id, count(*) AS created, count(*) FILTER (WHERE phase = 'terminal') AS ended, {", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in op.OUTCOMES)}, max(selection) AS sequence, max(created_at) AS changed FROM jobs WHERE parent_id IS NOT NULL GROUP BY parent_id)
SELECT job_id, {", ".join(f"coalesce({n}, 0) AS {n}" for n in ("created", "ended", *op.OUTCOMES, "sequence"))}, changed FROM jobs LEFT JOIN k ON k.parent_id = job_id WHERE jobs.parent_id IS NULL""")
def child_totals(spark, sf_dir):
    """Each parent's children in all and by outcome."""
    return op.child_totals(entity(spark, sf_dir, "jobs"), "created_at", "selection")


@query(f"""{sql("jobs")} SELECT job_id FROM jobs j WHERE phase = 'terminal' AND terminal_at < TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = job_id AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = job_id AND l_quantity > 48)
  AND NOT EXISTS (SELECT 1 FROM jobs k WHERE k.parent_id = j.job_id AND k.phase <> 'terminal') ORDER BY terminal_at, job_id LIMIT 101""")
def retention_due(spark, sf_dir):
    """Old ended jobs without live artifacts, live logs or active children."""
    f = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "job_id")
    return op.retention_due(entity(spark, sf_dir, "jobs"), [f.where("l_returnflag = 'R'"), f.where("l_quantity > 48")], at("1996-01-01"), 100).select("job_id")


UNCOVERED = """WITH q AS (SELECT DISTINCT l_orderkey AS request, l_suppkey AS subject FROM lineitem), a AS (SELECT s_suppkey AS subject, CASE WHEN s_suppkey % 7 > 0 THEN s_nationkey % 3 END AS parent FROM supplier WHERE s_suppkey % 5 < 3), w AS (SELECT s_suppkey AS subject FROM supplier WHERE s_suppkey % 11 = 4)"""


def uncovered(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("request"), c("l_suppkey").alias("subject")).distinct()
    s = table(spark, sf_dir, "supplier").withColumn("subject", c("s_suppkey"))
    return op.uncovered(q, s.where("s_suppkey % 5 < 3").select("subject", F.when(c("subject") % 7 > 0, c("s_nationkey") % 3).alias("parent")), s.where("s_suppkey % 11 = 4").select("subject"))


@query(f"{UNCOVERED} SELECT request, subject FROM q WHERE subject NOT IN (SELECT subject FROM a) AND subject NOT IN (SELECT subject FROM w)")
def uncovered_assets(spark, sf_dir):
    """What of each request is neither under way nor in review."""
    return uncovered(spark, sf_dir)[0]


@query(f"{UNCOVERED} SELECT request, min(parent) AS parent FROM q LEFT JOIN a USING (subject) GROUP BY request HAVING count(*) = count(parent) AND min(parent) = max(parent)")
def reused_batch(spark, sf_dir):
    """The batch that already does all of a request."""
    return uncovered(spark, sf_dir)[1]


@query("""WITH w AS (SELECT DISTINCT o_custkey AS profile, o_orderkey % 8 AS input FROM orders), b AS (SELECT DISTINCT o_custkey AS profile, o_orderkey % 8 AS input FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 6 > 0)
SELECT coalesce(w.profile, b.profile) AS profile, count(*) FILTER (WHERE w.input IS NULL OR b.input IS NULL) AS changed, count(b.input) = 0 OR count(*) FILTER (WHERE w.input IS NULL OR b.input IS NULL) >= 3 AS due FROM w FULL JOIN b ON w.profile = b.profile AND w.input = b.input GROUP BY ALL""")
def rebuild_due(spark, sf_dir):
    """Which profiles have changed by enough inputs to be built again."""
    o = table(spark, sf_dir, "orders").select(c("o_custkey").alias("profile"), (c("o_orderkey") % 8).alias("input"), "o_orderstatus")
    return op.rebuild_due(o, o.where("o_orderstatus = 'F' AND profile % 6 > 0"), "profile", 3)


@query(f"""{sql("jobs")}, a AS (SELECT * FROM jobs WHERE phase <> 'terminal') SELECT job_id AS asked, first_value(job_id) OVER w AS active FROM a WINDOW w AS (PARTITION BY subject, type, priority ORDER BY created_at, job_id) QUALIFY active <> asked""")
def equal_request(spark, sf_dir):
    """The oldest active job of a subject that asks for the same."""
    return op.equal_active(entity(spark, sf_dir, "jobs"), "subject", ["type", "priority"])


@query(f"{sql('jobs')} SELECT job_id, level FROM jobs ORDER BY CASE WHEN parent_id IS NULL THEN NULL ELSE priority END NULLS FIRST, job_id LIMIT 100")
def unplaced_first(spark, sf_dir):
    """Jobs without a place in the order stand before all others."""
    j = entity(spark, sf_dir, "jobs").withColumn("place", F.when(c("parent_id").isNotNull(), c("priority")))
    return j.orderBy(c("place").asc_nulls_first(), "job_id").limit(100).select("job_id", "level")
