"""Queries over the ordered log `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import timeseries as ts
from ..sources.tables import table
from ..streaming import log, timers
from ..streaming import progress as pg
from .registry import query

c = F.col


def events(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""WITH e AS (SELECT event_id, user_id, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS counter, lag(CAST(json_extract(props, '$.k') AS BIGINT)) OVER w AS before, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(CASE WHEN gap > 0 AND counter >= before THEN (counter - before) / gap END, 6) AS rate FROM e""")
def counter_rate(spark, sf_dir):
    """Each user's counter as a rate; resets give null."""
    e = events(spark, sf_dir).withColumn("counter", F.get_json_object("props", "$.k").cast("long"))
    return ts.counter_rate(e, ["user_id"], ["ts", "event_id"], "ts", "counter").select("event_id", F.round("rate", 6).alias("rate"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events),
b AS (SELECT *, place // greatest(CAST(ceil(n / 40) AS BIGINT), 1) AS bucket, place % greatest(CAST(ceil(n / 40) AS BIGINT), 1) AS pos FROM e), k AS (SELECT *, count(*) OVER (PARTITION BY event_type, bucket) AS r FROM b)
SELECT event_type, bucket, count(*) AS rows, round(avg(value), 3) AS mean, max(CASE WHEN pos = least(r - 1, r // 2) THEN ts END) AS ts FROM k GROUP BY event_type, bucket""")
def downsample_positional(spark, sf_dir):
    """Forty buckets of each type by position, with the middle row's time."""
    return ts.downsample(events(spark, sf_dir), ["event_type"], ["ts", "event_id"], 40, "value", "ts", F.date_trunc("day", "ts"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-30' AND coalesce(CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 30 DAY END, TIMESTAMP '1995-06-30') >= TIMESTAMP '1995-06-01'""")
def interval_overlap(spark, sf_dir):
    """Jobs that ran at any time of a window; running ones have no end."""
    o = table(spark, sf_dir, "orders")
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1995-06-01", "1995-06-30"))
    finish = F.when(c("o_orderstatus") != "O", c("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return o.where(ts.overlaps(c("o_orderdate"), finish, low, high)).select("o_orderkey")


@query("SELECT (epoch_us(ts) // 60000000) - (epoch_us(ts) // 60000000) % 15 AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def epoch_bucket(spark, sf_dir):
    """Occurrences in tumbling schedule buckets of fifteen minutes."""
    return events(spark, sf_dir).groupBy(ts.minute_bucket(c("ts"), 15).alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, 'k' AS key, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS mean, sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS total FROM events GROUP BY event_type")
def json_map_key_stats(spark, sf_dir):
    """Mean and total of each key of a JSON map."""
    m = events(spark, sf_dir).select("event_type", F.explode(F.from_json("props", "map<string,double>")).alias("key", "v"))
    return m.groupBy("event_type", "key").agg(F.round(F.avg("v"), 6).alias("mean"), F.sum("v").alias("total"))


@query("""WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) SELECT user_id, CASE WHEN last >= TIMESTAMP '2024-01-30 20:00:00' THEN 'active' WHEN last >= TIMESTAMP '2024-01-30' THEN 'stale' ELSE 'stopped' END AS state FROM l""")
def heartbeat_state(spark, sf_dir):
    """Workers by how long ago they were heard of, at a given now."""
    last = events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("last"))
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return last.select("user_id", F.when(c("last") >= at("2024-01-30 20:00:00"), "active").when(c("last") >= at("2024-01-30"), "stale").otherwise("stopped").alias("state"))


@query("SELECT min(event_id) AS oldest, max(event_id) AS newest, count(*) AS n FROM events")
def stream_bounds(spark, sf_dir):
    return events(spark, sf_dir).agg(F.min("event_id").alias("oldest"), F.max("event_id").alias("newest"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200")
def cursor_tail(spark, sf_dir):
    """The next bounded batch behind a cursor."""
    return events(spark, sf_dir).where(c("event_id") > 500).orderBy("event_id").limit(200).select("event_id", "event_type")


@query("""WITH e AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM events)
SELECT user_id, count(*) FILTER (WHERE most IS NULL OR value > most) AS accepted, count(*) FILTER (WHERE value <= most) AS refused FROM e GROUP BY user_id""")
def monotone_progress(spark, sf_dir):
    """Progress reports of each worker: those not above the highest so far are refused."""
    most = F.max("value").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    e = events(spark, sf_dir).withColumn("most", most)
    return e.groupBy("user_id").agg(F.count_if(c("most").isNull() | (c("value") > c("most"))).alias("accepted"), F.count_if(c("value") <= c("most")).alias("refused"))


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) // 1000000 AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_dedup_tumbling(spark, sf_dir):
    """The log as a stream, read twice over: repeated events are dropped and tumbling windows of six hours counted."""
    return log.dedup_windows(spark, f"{sf_dir}/events.parquet")


@query("""SELECT user_id, count(*) AS accepted, max(value) AS level FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM events) WHERE most IS NULL OR value > most GROUP BY user_id""")
def stream_progress(spark, sf_dir):
    """The same refusal of stale progress as a keyed-state stream; the final state of each worker."""
    return log.progress(spark, f"{sf_dir}/events.parquet")


CLIENTS = "SELECT c_custkey AS client, CASE WHEN c_custkey % 10 = 1 THEN -5 WHEN c_custkey % 10 = 2 THEN e.hi + 10 WHEN c_custkey % 10 > 2 THEN e.hi - (c_custkey * 97) % 1100 END AS after FROM customer, e"
RESUME_SQL = f"l AS (SELECT event_id AS cursor FROM events), e AS (SELECT min(cursor) AS lo, max(cursor) AS hi FROM l), k AS ({CLIENTS})"


def clients(spark, sf_dir: str) -> DataFrame:
    """Places in the log of clients that come back: most some way before its end, some nowhere, some beyond it."""
    k, hi = c("c_custkey"), events(spark, sf_dir).agg(F.max("event_id").alias("hi"))  # one row
    after = F.when(k % 10 == 1, -5).when(k % 10 == 2, c("hi") + 10).when(k % 10 > 2, c("hi") - (k * 97) % 1100)
    return table(spark, sf_dir, "customer").crossJoin(F.broadcast(hi)).select(k.alias("client"), after.alias("after"))


@query(f"""WITH {RESUME_SQL}, j AS (SELECT client, coalesce(after, hi) AS after, lo, hi FROM k, e), r AS (SELECT *, after < 0 OR after > hi OR after < lo - 1 OR hi - after > 600 AS reset FROM j)
SELECT client, reset, CASE WHEN reset THEN hi ELSE after END AS next, CASE WHEN reset THEN 0 ELSE hi - after END AS missed FROM r""")
def event_resume(spark, sf_dir):
    """What clients that come back to the log get: the rows they missed, or a reset."""
    return pg.resume(events(spark, sf_dir).select(c("event_id").alias("cursor")), clients(spark, sf_dir), 600)[0]


@query(f"""WITH {RESUME_SQL} SELECT client, cursor FROM k JOIN e ON after >= 0 AND after >= lo - 1 AND after <= hi AND hi - after <= 600 JOIN l ON cursor > after""")
def event_replay(spark, sf_dir):
    """The rows that clients are sent again."""
    return pg.resume(events(spark, sf_dir).select(c("event_id").alias("cursor")), clients(spark, sf_dir), 600)[1]


@query("""WITH k AS (SELECT DISTINCT user_id AS client, ['click', 'error', 'login', 'purchase', 'view'][1 + user_id % 5] AS topic, user_id * 3 AS after FROM events), n AS (SELECT client, count(*) AS n, max(event_id) AS last FROM k JOIN events ON event_type = topic AND event_id > after GROUP BY client)
SELECT client, coalesce(n, 0) AS offered, CASE WHEN n > 16 THEN 1 + (n - 17) // 16 ELSE 0 END AS overflows, CASE WHEN n > 16 THEN 1 + (n - 17) % 16 ELSE coalesce(n, 0) END AS queued, coalesce(last, after) AS next FROM k LEFT JOIN n USING (client)""")
def event_fanout(spark, sf_dir):
    """A burst of frames to clients with bounded queues."""
    e = events(spark, sf_dir)
    topic = F.element_at(F.array(*[F.lit(t) for t in ("click", "error", "login", "purchase", "view")]), (c("client") % 5 + 1).cast("int"))
    k = e.select(c("user_id").alias("client")).distinct().withColumns({"topic": topic, "after": c("client") * 3})
    return pg.fan_out(e.select(c("event_id").alias("cursor"), c("event_type").alias("topic")), k, 16)


REPORT_SQL = """o AS (SELECT user_id AS job, epoch_us(ts) / 1e6 AS moment, CASE WHEN event_id % 8 = 0 THEN 'b' ELSE 'a' END AS stage, CAST(event_id % 100 AS DOUBLE) AS share FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY moment, stage) AS k FROM o)"""


@query(f"""WITH RECURSIVE {REPORT_SQL}, s AS (
  SELECT job, k, moment AS last, stage, share, NULL::DOUBLE AS waits, NULL::VARCHAR AS w_stage, NULL::DOUBLE AS w_share, NULL::DOUBLE AS timer, NULL::DOUBLE AS fired, NULL::DOUBLE AS fired_of, moment AS wrote FROM n WHERE k = 1
  UNION ALL SELECT job, k, CASE WHEN now THEN moment ELSE last END, CASE WHEN now THEN new_stage ELSE stage END, CASE WHEN now THEN new_share ELSE share END, CASE WHEN now THEN NULL ELSE moment END, new_stage, new_share,
    CASE WHEN now THEN timer ELSE coalesce(timer, moment + 3600.0) END, fired, fired_of, CASE WHEN now THEN moment END
  FROM (SELECT *, stage <> new_stage OR new_share - share >= 60.0 OR moment - last >= 20000.0 AS now FROM (
    SELECT n.job, n.k, n.moment, n.stage AS new_stage, n.share AS new_share, CASE WHEN due THEN t.timer ELSE t.last END AS last, CASE WHEN due THEN t.w_stage ELSE t.stage END AS stage, CASE WHEN due THEN t.w_share ELSE t.share END AS share,
      CASE WHEN t.timer <= n.moment THEN NULL ELSE t.timer END AS timer, CASE WHEN due THEN t.timer END AS fired, CASE WHEN due THEN t.waits END AS fired_of
    FROM (SELECT s.*, m.moment AS next_at, coalesce(s.timer <= m.moment AND s.waits IS NOT NULL, false) AS due FROM s JOIN n m ON m.job = s.job AND m.k = s.k + 1) t JOIN n ON n.job = t.job AND n.k = t.k + 1)))
SELECT job, round(fired, 3) AS written, round(fired_of, 3) AS observed FROM s WHERE fired IS NOT NULL UNION ALL SELECT job, round(wrote, 3), round(wrote, 3) FROM s WHERE wrote IS NOT NULL
UNION ALL SELECT job, round(timer, 3), round(waits, 3) FROM s WHERE waits IS NOT NULL AND k = (SELECT max(k) FROM n WHERE n.job = s.job)""")
def progress_coalesced(spark, sf_dir):
    """Which of a user's reports are written, and when, as a stream with timers: changes at once, the rest at a bounded pace."""
    e = log.source(spark, f"{sf_dir}/events.parquet")
    o = e.select(c("user_id").alias("job"), "ts", (F.unix_micros("ts") / 1e6).alias("at"), F.when(c("event_id") % 8 == 0, "b").otherwise("a").alias("stage"), (c("event_id") % 100).cast("double").alias("share"), F.lit(0).cast("long").alias("warnings"))
    path = timers.until_quiet(spark, o, lambda s: timers.paced(s, cadence=3600.0, staleness=20_000.0, delta=60.0), "paced")
    return spark.read.schema("job long, written double, observed double").parquet(path).select("job", F.round("written", 3).alias("written"), F.round("observed", 3).alias("observed"))


@query("""WITH b AS (SELECT user_id AS worker, epoch_us(ts) // 1000 AS moment, event_type = 'error' AS stopped, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id)),
l AS (SELECT *, lag(moment) OVER w AS before, lag(stopped) OVER w AS was, lead(moment) OVER w AS after FROM b WINDOW w AS (PARTITION BY worker ORDER BY k))
SELECT worker, moment, 'stopped' AS status FROM l WHERE stopped AND NOT coalesce(was, false) UNION ALL SELECT worker, moment, 'active' FROM l WHERE NOT stopped AND (before IS NULL OR was OR moment - before >= 21600000)
UNION ALL SELECT worker, moment + 21600000, 'stale' FROM l WHERE NOT stopped AND (after IS NULL OR after - moment >= 21600000)""")
def stream_liveness(spark, sf_dir):
    """When workers come alive, stop and fall silent, as a stream whose timers tell of silence without a new beat."""
    e = log.source(spark, f"{sf_dir}/events.parquet")
    b = e.select(c("user_id").alias("worker"), "ts", c("event_id").alias("nth"), (c("event_type") == "error").alias("stopped"))
    path = timers.until_quiet(spark, b, lambda s: timers.liveness(s, 6 * 3_600_000), "liveness")
    return spark.read.schema("worker long, at long, status string").parquet(path).withColumnRenamed("at", "moment")


@query("SELECT event_id AS cursor, event_type AS topic FROM events")
def stream_resume(spark, sf_dir):
    """The whole log to a consumer that stopped after its first files and came back."""
    lines = events(spark, sf_dir).select(c("event_id").alias("cursor"), c("event_type").alias("topic"))
    return timers.resumed(spark, timers.as_files(lines, "cursor", 8), "cursor long, topic string", 2)


ITEM_SQL = """f AS (SELECT user_id AS item, event_id AS seq, CASE WHEN event_type = 'error' AND value > 20 THEN 'failed' WHEN event_type = 'purchase' AND value > 30 THEN 'succeeded' ELSE 'running' END AS status, CASE WHEN event_id % 10 < 7 THEN 'fetch' ELSE 'rank' END AS stage, CASE WHEN event_id % 3 > 0 THEN event_id % 50 END AS completed, 50 AS total FROM events)"""


@query(f"""WITH {ITEM_SQL}, e AS (SELECT item, min(seq) FILTER (WHERE status <> 'running') AS over FROM f GROUP BY item), k AS (SELECT f.* FROM f JOIN e USING (item) WHERE over IS NULL OR seq <= over),
s AS (SELECT *, stage IS DISTINCT FROM lag(stage) OVER (PARTITION BY item ORDER BY seq) AS new FROM k), r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY item ORDER BY seq) AS run FROM s), l AS (SELECT *, max(run) OVER (PARTITION BY item) AS last FROM r)
SELECT item, max_by(status, seq) AS status, max_by(stage, seq) AS stage, CASE WHEN max_by(status, seq) = 'running' THEN max_by(completed, seq) FILTER (WHERE run = last AND completed IS NOT NULL) END AS completed, CASE WHEN max_by(status, seq) = 'running' AND count(*) FILTER (WHERE run = last AND completed IS NOT NULL) > 0 THEN 50 END AS total FROM l GROUP BY item""")
def item_state(spark, sf_dir):
    """Where each item of a job stands after its frames."""
    status = F.when((c("event_type") == "error") & (c("value") > 20), "failed").when((c("event_type") == "purchase") & (c("value") > 30), "succeeded").otherwise("running")
    f = events(spark, sf_dir).select(c("user_id").alias("item"), c("event_id").alias("seq"), status.alias("status"), F.when(c("event_id") % 10 < 7, "fetch").otherwise("rank").alias("stage"), F.when(c("event_id") % 3 > 0, c("event_id") % 50).alias("completed"), F.lit(50).alias("total"))
    return pg.item_state(f)


@query("""WITH RECURSIVE r AS (SELECT user_id AS job, event_id // 4000 AS fence, event_id // 2 AS seq, event_type AS scope, CASE WHEN event_id % 7 > 0 THEN CAST(event_id % 50 AS DOUBLE) END AS share, row_number() OVER (PARTITION BY user_id ORDER BY event_id // 4000, event_id // 2, event_id) AS k FROM events),
s AS (SELECT job, k, fence, seq, scope, share, 1::BIGINT AS accepted, 0::BIGINT AS refused FROM r WHERE k = 1
UNION ALL SELECT job, k, CASE WHEN ok THEN nf ELSE fence END, CASE WHEN ok THEN ns ELSE seq END, CASE WHEN ok THEN nc ELSE scope END, CASE WHEN ok THEN nh ELSE share END, accepted + CASE WHEN ok THEN 1 ELSE 0 END, refused + CASE WHEN ok THEN 0 ELSE 1 END FROM (
  SELECT s.* EXCLUDE (k), r.k, r.fence AS nf, r.seq AS ns, r.scope AS nc, r.share AS nh, r.fence > s.fence OR (r.seq > s.seq AND NOT coalesce(r.scope = s.scope AND r.share < s.share, false)) AS ok FROM s JOIN r ON r.job = s.job AND r.k = s.k + 1))
SELECT job, fence, seq AS sequence, accepted, refused, share FROM s QUALIFY row_number() OVER (PARTITION BY job ORDER BY k DESC) = 1""")
def stream_valid_progress(spark, sf_dir):
    """Reports with a fence as a keyed-state stream: falling shares and repeated numbers are refused, the state is the last of each worker."""
    share = F.when(c("event_id") % 7 > 0, (c("event_id") % 50).cast("double"))
    s = log.source(spark, f"{sf_dir}/events.parquet").select(c("user_id").alias("job"), "ts", F.floor(c("event_id") / 2).alias("seq"), F.floor(c("event_id") / 4000).alias("fence"), c("event_type").alias("scope"), share.alias("share"))
    return pg.valid_progress(s, spark)


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events), b AS (SELECT *, place // greatest(CAST(ceil(n / 25) AS BIGINT), 1) AS bucket FROM e)
SELECT event_type, bucket, count(*) AS rows, max(user_id) AS peak FROM b GROUP BY ALL""")
def downsample_peaks(spark, sf_dir):
    """Buckets by position with the largest value of another column."""
    out = ts.downsample(events(spark, sf_dir), ["event_type"], ["ts", "event_id"], 25, "value", "ts", F.date_trunc("day", "ts"), "user_id")
    return out.select("event_type", "bucket", "rows", "peak")


@query("""SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) // 1000000 AS sampled, round(avg(value), 6) AS gauge, max(value) AS peak, list_sort(list(DISTINCT user_id) FILTER (WHERE event_type = 'login')) AS active FROM events GROUP BY 1""")
def host_samples(spark, sf_dir):
    """Samples of a gauge every six hours, each with the workers that were active."""
    w = events(spark, sf_dir).groupBy(F.window(c("ts").cast("timestamp"), "6 hours").alias("w"))
    s = w.agg(F.round(F.avg("value"), 6).alias("gauge"), F.max("value").alias("peak"), F.collect_set(F.when(c("event_type") == "login", c("user_id"))).alias("active"))
    return s.select(F.unix_seconds("w.start").alias("sampled"), "gauge", "peak", F.when(F.size("active") > 0, F.sort_array("active")).alias("active"))
