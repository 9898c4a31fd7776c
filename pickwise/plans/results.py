"""Queries on what a run shows of its candidates, and on single measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts, vectors
from ..operators import results as op
from ..operators import timeseries as ts
from ..sources import publish, tables
from ..sources.tables import table
from ..streaming import log
from .registry import query

c = F.col
REASONS = ("dedup_sha256", "dedup_phash: 3 bits", "resolution_floor", "aesthetic_floor", "text_heavy", "no_title", "format_blocklist", "fan_junk_combo", "feature_error: no face", "ocr_timeout", "has_title", "odd_new_reason", "")
RUN_SQL = f"""v AS (SELECT p_brand || ':' || (p_partkey // 400) AS run, p_partkey AS candidate_id, CASE WHEN p_partkey % 3 > 0 THEN [{", ".join(f"'{r}'" for r in REASONS)}][1 + p_partkey % 13] END AS reason, CASE WHEN p_partkey % 4 = 0 THEN 'ocr' ELSE 'features' END AS reached, p_retailprice AS price FROM part),
r AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY run, reason IS NULL ORDER BY price DESC, candidate_id) END AS rank FROM v)"""
STAGE_SQL = """CASE WHEN split_part(coalesce(reason, ''), ':', 1) IN ('dedup_sha256') THEN 'sha256' WHEN reason LIKE 'dedup_phash%' THEN 'phash' WHEN reason = 'resolution_floor' THEN 'resolution' WHEN reason = 'aesthetic_floor' THEN 'style'
 WHEN reason IN ('text_heavy', 'no_title', 'format_blocklist') OR reason LIKE 'ocr%' THEN 'ocr' WHEN reason = 'fan_junk_combo' THEN 'fan_junk' WHEN reason LIKE 'feature_error%' THEN 'errored' WHEN reached = 'ocr' THEN 'ocr' ELSE 'style' END"""


def run(spark, sf_dir: str) -> DataFrame:
    """Candidates of a run for each brand: a third is ranked, in stacks of three by rank, the rest turned away."""
    reason = F.when(c("p_partkey") % 3 > 0, F.element_at(F.array(*[F.lit(r) for r in REASONS]), (c("p_partkey") % 13 + 1).cast("int")))
    p = table(spark, sf_dir, "part").select(F.concat_ws(":", "p_brand", F.floor(c("p_partkey") / 400)).alias("run"), c("p_partkey").alias("candidate_id"), reason.alias("reason"), F.when(c("p_partkey") % 4 == 0, "ocr").otherwise("features").alias("reached"), c("p_retailprice").alias("price"))
    place = F.row_number().over(Window.partitionBy("run", c("reason").isNull()).orderBy(c("price").desc(), "candidate_id"))
    r = p.withColumn("rank", F.when(c("reason").isNull(), place))
    return r.withColumns({"stack_rank": F.floor((c("rank") + 2) / 3), "stack_pos": (c("rank") - 1) % 3 + 1, "stack_score": c("price")})


@query(f"""WITH {RUN_SQL} SELECT candidate_id, {STAGE_SQL} AS stage,
 CASE WHEN reason LIKE 'dedup_%' THEN 'dedup' WHEN reason LIKE 'feature_error%' THEN 'errored' WHEN reason LIKE 'ocr%' OR reason IN ('no_text', 'no_title') OR reached = 'ocr' THEN 'ocr' ELSE 'gate' END AS grouped,
 CASE reason WHEN 'text_heavy' THEN 'Text heavy' WHEN 'no_title' THEN 'Title not matched' WHEN 'format_blocklist' THEN 'Format badge' WHEN 'has_title' THEN 'Title detected' END AS label,
 CASE WHEN reason = '' THEN 'Rejected.' WHEN reason = 'dedup_sha256' THEN 'Byte-for-byte duplicate of another candidate.' WHEN reason LIKE 'dedup_phash%' THEN 'Visually near-identical to another candidate.' WHEN reason = 'resolution_floor' THEN 'Image resolution is below the minimum width.'
   WHEN reason = 'aesthetic_floor' THEN 'Aesthetic floor.' WHEN reason = 'text_heavy' THEN 'Too much non-title text was detected.' WHEN reason = 'no_title' THEN 'Title not matched in detected text.' WHEN reason = 'format_blocklist' THEN 'Format badge detected.' WHEN reason = 'fan_junk_combo' THEN 'Fan junk combo.'
   WHEN reason LIKE 'feature_error%' THEN 'Could not be processed (image or download error).' WHEN reason = 'ocr_timeout' THEN 'Ocr timeout.' WHEN reason = 'has_title' THEN 'Title text is excluded by the active profile.' ELSE 'Odd new reason.' END AS sentence FROM r WHERE reason IS NOT NULL""")
def rejections(spark, sf_dir):
    """Where each candidate was turned away, in a tag and in a sentence."""
    r, why, far = run(spark, sf_dir).where("reason IS NOT NULL"), c("reason"), c("reached")
    return r.select("candidate_id", op.rejection_stage(why, far).alias("stage"), op.rejection_group(why, far).alias("grouped"), op.literal(op.REASON_LABEL, texts.reason_base(why)).alias("label"), op.rejection_sentence(why).alias("sentence"))


@query(f"""WITH {RUN_SQL} SELECT run, (rank + 2) // 3 AS stack_rank, round(max(price), 4) AS stack_score, count(*) AS size, min_by(candidate_id, rank) AS representative, list(candidate_id ORDER BY rank) AS members FROM r WHERE rank IS NOT NULL GROUP BY ALL""")
def result_stacks(spark, sf_dir):
    """The stacks of each run with their members in order."""
    return op.result_view(run(spark, sf_dir))[1].withColumn("stack_score", F.round("stack_score", 4))


@query(f"""WITH {RUN_SQL}, s AS (SELECT * FROM (VALUES (0, 'sha256'), (1, 'resolution'), (2, 'style'), (3, 'ocr'), (4, 'phash'), (5, 'fan_junk'), (6, 'errored')) t(place, stage)), g AS (SELECT run, {STAGE_SQL} AS stage, count(*) AS n FROM r WHERE rank IS NULL GROUP BY ALL)
SELECT run, place, s.stage, coalesce(n, 0) AS n FROM (SELECT DISTINCT run FROM r) CROSS JOIN s LEFT JOIN g USING (run, stage)""")
def result_by_stage(spark, sf_dir):
    """How many candidates of each run each stage turned away, with zeros, in the order of the stages."""
    return op.result_view(run(spark, sf_dir))[2]


@query("""WITH w AS (SELECT o_custkey % 50 AS library, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 1 END AS runs, o_orderkey % 40 + 60 AS a, o_orderkey % 40 + 50 AS b, CASE WHEN o_custkey % 50 <> 7 OR o_orderkey % 5 > 0 THEN o_orderkey % 30 + 20 END AS o, o_orderkey % 20 + 10 AS f, o_orderkey % 20 + 5 AS k FROM orders),
s AS (SELECT library, 0 AS place, 'total_candidates' AS stage, count(*) - count(a) AS miss, sum(a) AS n FROM w WHERE runs > 0 GROUP BY library UNION ALL SELECT library, 1, 'sha256_survivors', 0, sum(b) FROM w WHERE runs > 0 GROUP BY library UNION ALL SELECT library, 2, 'ocr_survivors', count(*) - count(o), sum(o) FROM w WHERE runs > 0 GROUP BY library
 UNION ALL SELECT library, 3, 'phash_survivors', count(*) - count(o), sum(o) FROM w WHERE runs > 0 GROUP BY library UNION ALL SELECT library, 4, 'feature_survivors', 0, sum(f) FROM w WHERE runs > 0 GROUP BY library UNION ALL SELECT library, 5, 'ranked', 0, sum(k) FROM w WHERE runs > 0 GROUP BY library),
d AS (SELECT *, greatest(coalesce(lag(n) OVER (PARTITION BY library ORDER BY place), n) - n, 0) AS dropped, place IN (0, 5) OR stage = 'ocr_survivors' AS keep FROM s WHERE miss = 0)
SELECT library, place, stage, CAST(n AS BIGINT) AS count, CAST(dropped AS BIGINT) AS dropped FROM d WHERE dropped > 0 OR keep""")
def candidate_funnel(spark, sf_dir):
    """What is left of all candidates after each stage, over the windows of a library that had runs."""
    o = c("o_orderkey")
    ocr = F.when((c("o_custkey") % 50 != 7) | (o % 5 > 0), o % 30 + 20)
    counts = {"total_candidates": o % 40 + 60, "sha256_survivors": o % 40 + 50, "ocr_survivors": ocr, "phash_survivors": ocr, "feature_survivors": o % 20 + 10, "ranked": o % 20 + 5}
    m = F.map_filter(F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    w = table(spark, sf_dir, "orders").select((c("o_custkey") % 50).alias("library"), F.when(o % 9 == 0, 0).otherwise(1).alias("window_runs"), m.alias("counts"))
    return op.funnel(w, "library").select("library", "place", "stage", c("count").cast("long"), c("dropped").cast("long"))


@query(f"""WITH {RUN_SQL}, k AS (SELECT run, candidate_id, rank, CASE WHEN rank % 10 > 0 THEN rank // 4 END AS stack FROM r WHERE rank IS NOT NULL), p AS (SELECT *, coalesce(stack, -1 - rank) AS card, row_number() OVER (PARTITION BY run, coalesce(stack, -1 - rank) ORDER BY rank) AS pos, stack % 3 = 0 AS open FROM k),
f AS (SELECT *, min(rank) OVER (PARTITION BY run, card) AS first_rank FROM p), d AS (SELECT *, dense_rank() OVER (PARTITION BY run ORDER BY first_rank) AS shown_rank FROM f)
SELECT run AS subject, candidate_id, shown_rank, CASE WHEN open THEN chr(CAST(64 + pos AS INT)) END AS suffix FROM d WHERE open OR pos = 1""")
def display_rank(spark, sf_dir):
    """The ranks that a flat list shows, with every third stack expanded."""
    k = run(spark, sf_dir).where("rank IS NOT NULL").select(c("run").alias("subject"), "candidate_id", "rank", F.when(c("rank") % 10 > 0, F.floor(c("rank") / 4)).alias("stack_id"))
    k = k.withColumn("stack_pos", F.row_number().over(Window.partitionBy("subject", F.coalesce("stack_id", -1 - c("rank"))).orderBy("rank")))
    return op.display_ranks(k, k.where("stack_id % 3 = 0").select("subject", "stack_id"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'custom' ELSE 'title_only' END AS mode, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END AS max_residual_boxes, CASE WHEN p_partkey % 5 = 0 THEN 0.1 ELSE 0.04 END AS max_residual_area, CASE WHEN p_partkey % 7 = 0 THEN false ELSE true END AS require_title, false AS allow_studio FROM part""")
def gate_knobs(spark, sf_dir):
    """Each knob from a profile, or from the settings where the profile is silent."""
    k = c("p_partkey")
    profile = {"mode": F.when(k % 3 == 0, "custom").when(k % 3 == 1, ""), "max_residual_boxes": F.when(k % 2 == 0, c("p_size")), "max_residual_area": F.when(k % 5 == 0, 0.1), "require_title": F.when(k % 7 == 0, False)}
    settings = {"mode": "title_only", "max_residual_boxes": 0, "max_residual_area": 0.04, "require_title": True, "allow_studio": False}
    return table(spark, sf_dir, "part").select("p_partkey", *[v.alias(n) for n, v in op.resolved(profile, settings).items()])


@query(r"""WITH m AS (SELECT page_id, html, len(regexp_extract_all(html, '<[a-z][^>]*>')) AS tags, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS chars FROM pages)
SELECT page_id, CASE WHEN html <> '' AND page_id % 17 > 0 AND tags > 0 THEN round(chars / tags, 6) END AS value, CASE WHEN html IS NULL OR html = '' THEN 'empty' WHEN page_id % 17 = 0 OR tags = 0 THEN 'no_tags' END AS error FROM m""")
def detail_features(spark, sf_dir):
    """A page's text per tag; pages without text, or (every seventeenth, stripped here) without tags, tell so, the others have their value."""
    html = F.when(c("page_id") % 17 == 0, F.regexp_replace("html", "<[^>]*>", "")).otherwise(c("html"))
    tags, chars = F.regexp_count(html, F.lit("<[a-z][^>]*>")), F.length(F.regexp_replace(html, "<[^>]*>", ""))
    r = op.isolated(F.try_divide(chars, tags), {"empty": html.isNull() | (c("html") == ""), "no_tags": tags == 0})
    return table(spark, sf_dir, "pages").select("page_id", r.alias("r")).select("page_id", F.round("r.value", 6).alias("value"), "r.error")


@query("""WITH b AS (SELECT DISTINCT p_brand, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS n FROM part), s AS (SELECT p_brand, ['auto', 'weighted', 'residual'][1 + n % 3] AS mode, CASE WHEN n % 4 > 0 THEN 8 + n % 2 END AS stored FROM b)
SELECT p_partkey, CASE WHEN mode = 'weighted' THEN 'weighted' WHEN stored = 9 THEN 'residual' WHEN mode = 'residual' THEN 'none' ELSE 'weighted' END AS scorer FROM part JOIN s USING (p_brand)""")
def scorer_choice(spark, sf_dir):
    """Which scorer each library's candidates get, by its mode and by whether the residual stored for it has the baseline's features."""
    p, n = table(spark, sf_dir, "part"), F.substring_index("p_brand", "#", -1).cast("int")
    mode = F.element_at(F.array(F.lit("auto"), F.lit("weighted"), F.lit("residual")), n % 3 + 1)
    stored = p.select("p_brand").distinct().select("p_brand", mode.alias("mode"), F.when(n % 4 > 0, 8 + n % 2).alias("stored"))
    return p.join(stored, "p_brand").select("p_partkey", op.chosen_scorer(c("mode"), c("stored"), F.lit(9)).alias("scorer"))


@query("WITH r AS (SELECT p_type || ': ' || p_name AS reason FROM part) SELECT split_part(reason, ':', 1) AS base, count(*) AS n FROM r GROUP BY base")
def reason_bases(spark, sf_dir):
    """Reasons counted without their details."""
    r = table(spark, sf_dir, "part").select(texts.reason_base(F.concat("p_type", F.lit(": "), "p_name")).alias("base"))
    return r.groupBy("base").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity * 2.0 * (l_linenumber * 3.0) / 2 AS area, round(CASE WHEN l_quantity > 10 THEN (l_quantity - 10) / (l_quantity + 10) ELSE 0 END, 9) AS overlap FROM lineitem""")
def box_geometry(spark, sf_dir):
    """The area of a triangle by its corners, and how far two boxes overlap."""
    q, n, zero = c("l_quantity"), c("l_linenumber").cast("double"), F.lit(0.0)
    area = vectors.shoelace(F.array(zero, q * 2, zero), F.array(zero, zero, n * 3))
    over = vectors.iou((zero, zero, q, F.lit(5.0)), (F.lit(10.0), zero, q + 10, F.lit(5.0)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", area.alias("area"), F.round(over, 9).alias("overlap"))


@query("SELECT p_partkey, 1 - bit_count(xor(p_partkey * 2654435761, p_partkey * 40503)) / 64.0 AS similarity FROM part")
def hash_similarity(spark, sf_dir):
    """How alike two 64-bit hashes are."""
    k = c("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", vectors.hamming_similarity(k * 2654435761, k * 40503).alias("similarity"))


HEAD = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
AXES = {"warm": [round(((i * 11) % 7 - 3) / 10, 1) for i in range(64)], "busy": [round(((i * 5) % 9 - 4) / 10, 1) for i in range(64)]}


@query(f"WITH {'u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)'} SELECT vec_id, round(list_dot_product(v, {HEAD}::DOUBLE[]) + 0.25, 6) AS aesthetic, round(list_dot_product(v, {AXES['warm']}::DOUBLE[]), 6) AS warm, round(list_dot_product(v, {AXES['busy']}::DOUBLE[]), 6) AS busy FROM u")
def linear_heads(spark, sf_dir):
    """A linear head with a bias, and the scores of named directions, on unit vectors."""
    v = vectors.unit(c("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.linear(v, HEAD, 0.25), 6).alias("aesthetic"), *[F.round(s, 6).alias(k) for k, s in vectors.axes(v, AXES).items()])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 AND l_quantity >= l_linenumber THEN round((l_quantity - (l_linenumber - 1)) / ((l_linenumber - 1) / 30.0), 6) END AS eta FROM (SELECT * FROM lineitem WHERE l_quantity >= l_linenumber - 1)")
def progress_eta(spark, sf_dir):
    """The seconds left at the pace so far."""
    f = table(spark, sf_dir, "lineitem").where("l_quantity >= l_linenumber - 1")
    done = c("l_linenumber") - 1
    return f.select("l_orderkey", "l_linenumber", F.round(F.when(c("l_quantity") >= c("l_linenumber"), ts.eta(done, c("l_quantity"), F.lit(30.0))), 6).alias("eta"))


@query("SELECT event_id AS cursor, event_type AS source FROM events WHERE event_id > 1000 AND event_type = 'click' AND user_id % 2 = 0 ORDER BY event_id LIMIT 101")
def log_page(spark, sf_dir):
    """A page of a log behind a cursor, of one source and level."""
    lines = table(spark, sf_dir, "events").select(c("event_id").alias("cursor"), c("event_type").alias("source"), F.when(c("user_id") % 2 == 0, "info").otherwise("debug").alias("level"))
    return tables.log_page(lines, 1000, "click", "info", 100).select("cursor", "source")


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_type = 'click' THEN user_id END AS user_id FROM events""")
def event_details(spark, sf_dir):
    """Of an event's details only those that its type may show."""
    e = table(spark, sf_dir, "events")
    details = F.map_concat(F.from_json("props", "map<string,bigint>"), F.create_map(F.lit("user"), c("user_id")))
    m = log.allowed_details(details, c("event_type"), {"click": ["k", "user"], "purchase": ["k"]})
    return e.select("event_id", m.alias("m")).select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("user")).alias("user_id"))


@query("""SELECT p_brand || ':' || (p_partkey // 400) AS subject, p_partkey AS candidate_id, row_number() OVER (PARTITION BY p_brand, p_partkey // 400 ORDER BY p_size DESC, p_partkey % 5 DESC, p_partkey) AS place FROM part""")
def listing_order(spark, sf_dir):
    """Nested lists of candidates as rows, the best voted of each subject first."""
    p = table(spark, sf_dir, "part")
    nested = p.groupBy(F.concat_ws(":", "p_brand", F.floor(c("p_partkey") / 400)).alias("subject")).agg(F.collect_list(F.struct(c("p_partkey").alias("candidate_id"), c("p_size").alias("vote_average"), (c("p_partkey") % 5).alias("vote_count"))).alias("candidates"))
    return tables.listing_candidates(nested, "candidate_id").select("subject", "candidate_id", "place")


@query("SELECT CASE WHEN p_size < 10 THEN 'too_small' ELSE 'off_style' END AS gate_reason, count(*) AS n FROM part WHERE p_size < 10 OR p_retailprice < 950 GROUP BY gate_reason")
def gated_outputs(spark, sf_dir):
    """Rejected rows written by reason and read again."""
    p = table(spark, sf_dir, "part").withColumn("gate_reason", F.when(c("p_size") < 10, "too_small").when(c("p_retailprice") < 950, "off_style"))
    path = log.shared_folder(spark, "gated")
    tables.write_gated(p.select("p_partkey", "gate_reason"), path)
    return spark.read.parquet(path).groupBy("gate_reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def guarded_profile(spark, sf_dir):
    """A stored profile, every row of which is checked for its model and length as it is read."""
    path = log.shared_folder(spark, "profile")
    table(spark, sf_dir, "embeddings").select("label", "embedding", F.lit("m1").alias("model")).write.parquet(path)
    return tables.load_profile(spark, path, "m1", 64).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size / 2.0 END AS x, CASE WHEN p_partkey % 3 > 0 THEN p_size / 2.0 END AS inner_x, CASE WHEN p_partkey % 3 > 0 THEN p_size / 2.0 END AS item FROM part")
def finite_archive(spark, sf_dir):
    """Rows written as JSON with NaN and infinities as nulls, at any depth, and read again."""
    x = F.when(c("p_partkey") % 3 > 0, c("p_size") / 2.0).when(c("p_partkey") % 3 == 0, F.lit(float("nan")))
    inf = F.when(c("p_partkey") % 3 > 0, c("p_size") / 2.0).otherwise(F.lit(float("inf")))
    path = log.shared_folder(spark, "archive")
    tables.write_json(table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), F.struct(inf.alias("x")).alias("s"), F.array(F.struct(x.alias("x"))).alias("a")), path)
    back = spark.read.schema("p_partkey long, x double, s struct<x: double>, a array<struct<x: double>>").json(path)
    return back.select("p_partkey", "x", c("s.x").alias("inner_x"), c("a")[0]["x"].alias("item"))


@query("SELECT o_custkey, count(*) AS n, 2::BIGINT AS version, true AS refused FROM orders GROUP BY o_custkey")
def published_evidence(spark, sf_dir):
    """A table published twice, with a publisher that broke off and one that came too late between: readers see the last whole version."""
    root, o = log.shared_folder(spark, "published"), table(spark, sf_dir, "orders")
    counts = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    first = publish.publish(counts.where("n > 3"), root, 0)
    publish.stage(counts.where("n > 5"), root)  # broke off before its manifest
    publish.publish(counts, root, first)
    try:
        publish.publish(counts.where("n > 7"), root, first)
        late = False
    except publish.Conflict:
        late = True
    return publish.published(spark, root).withColumns({"version": F.lit(publish.current(spark, root)).cast("long"), "refused": F.lit(late)})


@query("""WITH p AS (SELECT page_id % 16 AS folder, sum(strlen(coalesce(html, '')) + 1) AS length FROM pages GROUP BY 1), m AS (SELECT CAST(floor(avg(length)) AS BIGINT) AS most FROM p)
SELECT folder::BIGINT AS folder, length::BIGINT AS length, CASE WHEN length <= most THEN length::BIGINT END AS read FROM p, m""")
def gated_files(spark, sf_dir):
    """Pages as files, read back behind a gate on their size: large ones are told by name and size, their bytes are not read."""
    path = log.shared_folder(spark, "pages")
    p = table(spark, sf_dir, "pages").select((c("page_id") % 16).alias("folder"), F.coalesce("html", F.lit("")).alias("value"))
    p.repartition(16, "folder").sortWithinPartitions("folder").write.partitionBy("folder").text(path)
    most = tables.files(spark, path, "*.txt").agg(F.floor(F.avg("length"))).first()[0]
    small, large = tables.gated_files(spark, path, most, "*.txt")
    folder = F.regexp_extract("path", "folder=([0-9]+)/", 1).cast("long").alias("folder")
    return small.select(folder, "length", F.octet_length("content").cast("long").alias("read")).unionByName(large.select(folder, "length", F.lit(None).cast("long").alias("read")))


@query("""SELECT event_type AS topic, count(*) AS lines, max(event_id) AS cursor, round(sum(value), 4) AS total FROM events WHERE event_id % 50 > 0 GROUP BY 1
UNION ALL SELECT 'quarantine', count(*), NULL, NULL FROM events WHERE event_id % 50 = 0""")
def log_quarantine(spark, sf_dir):
    """A log as compressed JSON Lines, some of them cut short: whole lines by topic, and how many were set aside."""
    path = log.shared_folder(spark, "lines")
    e = table(spark, sf_dir, "events").select(F.to_json(F.struct(c("event_id").alias("cursor"), c("event_type").alias("topic"), "value")).alias("line"), "event_id")
    e.select(F.when(c("event_id") % 50 == 0, F.substring("line", 1, F.length("line") - 5)).otherwise(c("line")).alias("value")).write.option("compression", "gzip").text(path)
    good, bad = tables.quarantined(spark, path, "cursor long, topic string, value double")
    told = good.groupBy("topic").agg(F.count(F.lit(1)).alias("lines"), F.max("cursor").alias("cursor"), F.round(F.sum("value"), 4).alias("total"))
    return told.unionByName(bad.agg(F.lit("quarantine").alias("topic"), F.count(F.lit(1)).alias("lines"), F.lit(None).cast("long").alias("cursor"), F.lit(None).cast("double").alias("total")))
