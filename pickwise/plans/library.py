"""Queries over titles, series and seasons, their reviews and pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import sort_key
from ..operators import library as op
from ..operators import relational as rel
from ..sources.tables import table
from .entities import entity, sql
from .registry import query

c = F.col
REVIEW = "r.feedback IS NULL AND r.status IN ('completed', 'flagged_manual') AND (r.run_job IS NULL OR j.phase = 'terminal')"
PENDING = f"SELECT r.* FROM runs r LEFT JOIN jobs j ON j.job_id = r.run_job WHERE {REVIEW}"
SORT = r"regexp_replace(title, '^(the|an|a) ', '', 'i')"


def entities(spark, sf_dir: str, *names: str) -> list[DataFrame]:
    return [entity(spark, sf_dir, n) for n in names]


def flagged(titles: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """titles with review_pending: whether `found` holds the key."""
    return titles.join(found.select(key).distinct().withColumn("_f", F.lit(True)), key, "left").withColumn("review_pending", F.coalesce("_f", F.lit(False))).drop("_f")


@query(f"{sql('runs', 'jobs')} SELECT run_id, media_type FROM ({PENDING})")
def unresolved_reviews(spark, sf_dir):
    """Runs that want a decision: no feedback, a fitting status, and a job that ended or is not known."""
    return op.reviews(*entities(spark, sf_dir, "runs", "jobs")).select("run_id", "media_type")


@query("SELECT p_partkey AS season_id, p_partkey % 9 <> 0 AND p_partkey % 4 > 0 AS downloaded FROM part")
def season_downloaded(spark, sf_dir):
    """Seasons that are present and have files."""
    (s,) = entities(spark, sf_dir, "seasons")
    return s.select("season_id", op.season_downloaded(c("season_present"), c("episode_files")).alias("downloaded"))


@query(f"{sql('series', 'seasons')} SELECT series_id FROM series s WHERE series_present AND EXISTS (SELECT 1 FROM seasons k WHERE k.series_id = s.series_id AND season_present AND episode_files > 0)")
def series_visible(spark, sf_dir):
    """Series that a library shows."""
    return op.visible_series(*entities(spark, sf_dir, "series", "seasons")).select("series_id")


@query(f"""{sql("movies", "runs", "jobs", "files")}, p AS (SELECT DISTINCT movie_id FROM ({PENDING}) WHERE media_type = 'movie'), f AS (SELECT * FROM files WHERE active AND file_present QUALIFY row_number() OVER (PARTITION BY movie_id ORDER BY file_id DESC) = 1)
SELECT m.movie_id, title, year, f.file_id, f.size, false AS review_pending, CAST(count(*) OVER () AS BIGINT) AS total FROM movies m LEFT JOIN f ON f.movie_id = m.movie_id
WHERE is_present AND own_path IS NOT NULL AND title ILIKE '%the%0_3%' AND poster_path IS NULL AND m.movie_id NOT IN (SELECT movie_id FROM p) ORDER BY {SORT}, m.movie_id LIMIT 50""")
def library_movies(spark, sf_dir):
    """A page of titles: a search with signs taken as patterns, no picture yet, none in review, each with its file."""
    m, r, j, f = entities(spark, sf_dir, "movies", "runs", "jobs", "files")
    m = flagged(m.where("is_present AND own_path IS NOT NULL"), op.reviews(r, j).where("media_type = 'movie'"), "movie_id")
    m = m.where(c("title").ilike("%THE%0_3%") & c("poster_path").isNull() & ~c("review_pending"))
    page = m.orderBy(sort_key(c("title")), "movie_id").limit(50).join(op.active_file(f), "movie_id", "left")
    return page.crossJoin(m.agg(F.count(F.lit(1)).alias("total"))).select("movie_id", "title", "year", "file_id", "size", "review_pending", "total")


def pending_series(spark, sf_dir: str) -> DataFrame:
    """series_id of all series with a show or season run that wants a decision."""
    r, j, s = entities(spark, sf_dir, "runs", "jobs", "seasons")
    found = op.reviews(r, j)
    own = found.where("media_type = 'series'").select("series_id")
    return own.union(found.where("media_type = 'season'").select("season_id").join(s.select("season_id", "series_id"), "season_id").select("series_id")).distinct()


SERIES_LIST = f"""{sql("series", "seasons", "runs", "jobs")}, w AS ({PENDING}), p AS (SELECT series_id FROM w WHERE media_type = 'series' UNION SELECT k.series_id FROM w JOIN seasons k ON k.season_id = w.season_id WHERE media_type = 'season'),
d AS (SELECT series_id, count(*) AS downloaded, count(season_poster) AS with_poster FROM seasons WHERE season_present AND episode_files > 0 GROUP BY series_id)
"""


def listed_series(spark, sf_dir: str) -> DataFrame:
    s, k = entities(spark, sf_dir, "series", "seasons")
    d = k.where(op.season_downloaded(c("season_present"), c("episode_files"))).groupBy("series_id").agg(F.count(F.lit(1)).alias("downloaded"), F.count("season_poster").alias("with_poster"))
    return flagged(s.where("series_present").join(d, "series_id"), pending_series(spark, sf_dir), "series_id")


@query(f"{SERIES_LIST} SELECT s.series_id, title, downloaded, with_poster, s.series_id IN (SELECT series_id FROM p) AS review_pending FROM series s JOIN d USING (series_id) WHERE series_present ORDER BY title, s.series_id LIMIT 50")
def library_series(spark, sf_dir):
    """A page of series with their seasons' counts."""
    return listed_series(spark, sf_dir).orderBy("title", "series_id").limit(50).select("series_id", "title", "downloaded", "with_poster", "review_pending")


@query(f"""{SERIES_LIST}, x AS (SELECT s.series_id, s.series_id IN (SELECT series_id FROM p) AS review, with_poster + CASE WHEN show_poster IS NULL THEN 0 ELSE 1 END AS present, downloaded + 1 AS total FROM series s JOIN d USING (series_id) WHERE series_present)
SELECT series_id, CASE WHEN review THEN 'review' WHEN present = total THEN 'deployed' WHEN present > 0 THEN 'partial' ELSE 'missing' END AS state, present, total FROM x""")
def artwork_coverage(spark, sf_dir):
    """Whether a series has all of its pictures, some, none, or a decision pending."""
    state, present, total = op.coverage(c("show_poster"), c("with_poster"), c("downloaded"), c("review_pending"))
    return listed_series(spark, sf_dir).select("series_id", state.alias("state"), present.alias("present"), total.alias("total"))


@query(f"{sql('runs')} SELECT run_id, status, started_at, completed_at, feedback IS NOT NULL AS reviewed FROM runs WHERE movie_id = 77 ORDER BY started_at DESC, run_id")
def run_history(spark, sf_dir):
    """A title's runs, the newest first."""
    (r,) = entities(spark, sf_dir, "runs")
    return r.where("movie_id = 77").orderBy(c("started_at").desc(), "run_id").select("run_id", "status", "started_at", "completed_at", c("feedback").isNotNull().alias("reviewed"))


@query(f"""{sql("series", "seasons", "runs", "jobs")}, w AS ({PENDING}), busy AS (SELECT series_id FROM runs WHERE status = 'running' AND media_type = 'series'),
k AS (SELECT series_id, season_id, number FROM seasons WHERE season_present AND episode_files > 0), v AS (SELECT * FROM series s WHERE series_present AND series_id IN (SELECT series_id FROM k)),
n AS (SELECT v.series_id, list_sort(list(number) FILTER (WHERE season_id IN (SELECT p_partkey FROM part WHERE p_partkey % 5 >= 2) AND season_id NOT IN (SELECT season_id FROM w WHERE media_type = 'season'))) AS missing FROM v JOIN k USING (series_id) GROUP BY v.series_id),
r AS (SELECT v.series_id, title, show_poster IS NULL AND v.series_id NOT IN (SELECT series_id FROM w WHERE media_type = 'series') AND v.series_id NOT IN (SELECT series_id FROM busy) AS show_missing, coalesce(missing, []) AS missing_seasons, tmdb_id IS NULL AS no_tmdb FROM v JOIN n USING (series_id))
SELECT * FROM r WHERE show_missing OR len(missing_seasons) > 0""")
def tv_run_queue(spark, sf_dir):
    """Visible series with pictures that still want a run: neither deployed nor under way nor awaiting a decision."""
    s, k, r, j = entities(spark, sf_dir, "series", "seasons", "runs", "jobs")
    w = op.reviews(r, j)
    shows_out = w.where("media_type = 'series'").select("series_id").union(r.where("status = 'running' AND media_type = 'series'").select("series_id"))
    need = k.where(op.season_downloaded(c("season_present"), c("episode_files")) & c("season_poster").isNull())
    need = rel.missing(need, w.where("media_type = 'season'").select("season_id"), "season_id").groupBy("series_id").agg(F.sort_array(F.collect_list("number")).alias("missing_seasons"))  # a series' seasons
    v = flagged(op.visible_series(s, k), shows_out, "series_id").join(need, "series_id", "left").withColumn("missing_seasons", F.coalesce("missing_seasons", F.array().cast("array<int>")))
    v = v.withColumn("show_missing", c("show_poster").isNull() & ~c("review_pending"))
    return v.where(c("show_missing") | (F.size("missing_seasons") > 0)).select("series_id", "title", "show_missing", "missing_seasons", c("tmdb_id").isNull().alias("no_tmdb"))


@query(f"""{sql("series", "seasons", "runs", "jobs")}, w AS ({PENDING} AND r.media_type <> 'movie'), l AS (SELECT w.*, CASE media_type WHEN 'series' THEN w.series_id ELSE k.series_id END AS of_series, number FROM w LEFT JOIN seasons k ON media_type = 'season' AND k.season_id = w.season_id
  QUALIFY row_number() OVER (PARTITION BY media_type, CASE media_type WHEN 'series' THEN w.series_id ELSE w.season_id END ORDER BY started_at DESC, run_id) = 1)
SELECT s.series_id, s.title, max(run_id) FILTER (WHERE media_type = 'series') AS show_run, coalesce(list(run_id ORDER BY number, run_id) FILTER (WHERE media_type = 'season'), []) AS season_runs, count(*) FILTER (WHERE media_type = 'series') = 0 AS seasons_only
FROM l JOIN series s ON s.series_id = of_series GROUP BY s.series_id, s.title ORDER BY s.title, s.series_id LIMIT 20 OFFSET 5""")
def tv_review_queue(spark, sf_dir):
    """The latest undecided run of each show and season, grouped by series, paged by series."""
    s, k, r, j = entities(spark, sf_dir, "series", "seasons", "runs", "jobs")
    w = op.reviews(r, j).where("media_type <> 'movie'").withColumn("subject", F.when(c("media_type") == "series", c("series_id")).otherwise(c("season_id")))
    last = rel.latest(w, ["media_type", "subject"], [c("started_at").desc(), c("run_id")]).drop("series_id")
    own = last.join(k.select(c("season_id").alias("k_id"), c("series_id").alias("k_of"), "number"), (c("media_type") == "season") & (c("subject") == c("k_id")), "left")
    own = own.withColumn("series_id", F.when(c("media_type") == "series", c("subject")).otherwise(c("k_of")))
    g = own.groupBy("series_id").agg(F.max(F.when(c("media_type") == "series", c("run_id"))).alias("show_run"), F.sort_array(F.collect_list(F.when(c("media_type") == "season", F.struct("number", "run_id")))).alias("runs"))
    page = g.join(s, "series_id").orderBy("title", "series_id").offset(5).limit(20)
    return page.select("series_id", "title", "show_run", F.transform("runs", lambda x: x["run_id"]).alias("season_runs"), c("show_run").isNull().alias("seasons_only"))


#: Candidates of three kinds of subject that share ids, as a fetch would find them.
CANDIDATES = "SELECT l_orderkey * 10 + l_linenumber AS candidate_id, CASE l_linenumber % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'series' ELSE 'season' END AS media_type, l_partkey % 300 AS subject, CASE WHEN l_linenumber % 3 = 2 THEN l_suppkey % 4 END AS season, CASE WHEN l_suppkey % 10 > 0 THEN 300 + (l_partkey * 37) % 900 END AS width, CAST(l_quantity AS INT) AS votes FROM lineitem"


def fetched(spark, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem")
    kind = F.when(c("l_linenumber") % 3 == 0, "movie").when(c("l_linenumber") % 3 == 1, "series").otherwise("season")
    return f.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("candidate_id"), kind.alias("media_type"), (c("l_partkey") % 300).alias("subject"), F.when(c("l_linenumber") % 3 == 2, c("l_suppkey") % 4).alias("season"), F.when(c("l_suppkey") % 10 > 0, 300 + (c("l_partkey") * 37) % 900).alias("width"), c("l_quantity").cast("int").alias("votes"))


@query(f"WITH f AS ({CANDIDATES}) SELECT candidate_id, 'season' AS asked FROM f WHERE media_type = 'season' AND subject = 42 AND season = 2 UNION ALL SELECT candidate_id, 'movie' FROM f WHERE media_type = 'movie' AND subject = 42 UNION ALL SELECT candidate_id, 'series' FROM f WHERE media_type = 'series' AND subject = 42")
def namespaced_candidates(spark, sf_dir):
    """The candidates of three subjects that share one id, each from its own space."""
    f = fetched(spark, sf_dir)
    ask = [("season", 2), ("movie", None), ("series", None)]
    parts = [op.of_namespace(f, kind, 42, season).select("candidate_id", F.lit(kind).alias("asked")) for kind, season in ask]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH f AS ({CANDIDATES}) SELECT subject, count(*) AS found, count(*) FILTER (WHERE width < 500) AS gated, count(*) - count(*) FILTER (WHERE width < 500) AS to_fetch FROM f WHERE media_type = 'movie' GROUP BY subject")
def prefetch_gate(spark, sf_dir):
    """What the width gate spares a subject before anything is fetched."""
    f = fetched(spark, sf_dir).where("media_type = 'movie'").withColumn("ok", op.wide_enough(c("width"), 500))
    return f.groupBy("subject").agg(F.count(F.lit(1)).alias("found"), F.count_if(~c("ok")).alias("gated"), F.count_if("ok").alias("to_fetch"))


@query(f"WITH f AS ({CANDIDATES}) SELECT candidate_id, coalesce(width >= 800, true) AS kept FROM f")
def size_prefilter(spark, sf_dir):
    """Pictures narrower than asked go; those of unknown width stay."""
    return fetched(spark, sf_dir).select("candidate_id", op.wide_enough(c("width"), 800).alias("kept"))


@query(f"""{sql("series", "seasons")}, f AS (SELECT DISTINCT '/tv/' || CAST(series_id AS STRING) || '/poster.jpg' AS path FROM series WHERE series_id % 2 = 0 UNION SELECT DISTINCT '/tv/' || CAST(series_id AS STRING) || '/season' || lpad(CAST(number AS STRING), 2, '0') || '.jpg' FROM seasons WHERE number % 3 = 0),
p AS (SELECT 'show' AS asset_kind, series_id, NULL::INT AS number, '/tv/' || CAST(series_id AS STRING) || '/poster.jpg' AS path FROM series WHERE series_present
  UNION SELECT 'season', series_id, number, '/tv/' || CAST(series_id AS STRING) || '/season' || lpad(CAST(number AS STRING), 2, '0') || '.jpg' FROM seasons JOIN series USING (series_id) WHERE series_present AND season_present)
SELECT asset_kind, series_id, number, path FROM p WHERE path IN (SELECT path FROM f)""")
def tv_artwork_scan(spark, sf_dir):
    """Shows' and seasons' pictures that stand in their folders."""
    s, k = entities(spark, sf_dir, "series", "seasons")
    folder = lambda i: F.concat(F.lit("/tv/"), i.cast("string"))
    shows = s.where("series_id % 2 = 0").select(F.concat(folder(c("series_id")), F.lit("/poster.jpg")).alias("path"))
    own = k.where("number % 3 = 0").select(F.concat(folder(c("series_id")), F.lit("/season"), F.lpad(c("number").cast("string"), 2, "0"), F.lit(".jpg")))
    return op.deployed_artwork(s.withColumn("folder", folder(c("series_id"))), k, shows.union(own))


@query(f"{sql('movies')} SELECT movie_id, coalesce(nullif(substr(poster_sha, 1, 16), ''), CAST(CAST(epoch(deployed_at) AS BIGINT) AS STRING)) AS version FROM movies")
def poster_version(spark, sf_dir):
    """The token that changes with a deployed picture."""
    (m,) = entities(spark, sf_dir, "movies")
    return m.select("movie_id", op.poster_version(c("poster_sha"), c("deployed_at")).alias("version"))


@query("SELECT p_partkey, sha256('review-v1' || chr(0) || p_brand || chr(0) || p_name) AS candidate FROM part")
def opaque_candidate(spark, sf_dir):
    """Ids of candidates that tell nothing of their files."""
    return table(spark, sf_dir, "part").select("p_partkey", op.candidate_id(c("p_brand"), c("p_name"), "review-v1").alias("candidate"))


@query(f"""{sql("movies")}, done AS (SELECT DISTINCT o_custkey AS movie_id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000)
SELECT movie_id, title FROM movies WHERE is_present AND own_path IS NOT NULL AND movie_id NOT IN (SELECT movie_id FROM done) ORDER BY movie_id LIMIT 1""")
def onboarding_next(spark, sf_dir):
    """The first title with a file that nobody has decided on."""
    (m,) = entities(spark, sf_dir, "movies")
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 100000").select(c("o_custkey").alias("movie_id"))
    return rel.missing(m.where("is_present AND own_path IS NOT NULL"), done, "movie_id").orderBy("movie_id").limit(1).select("movie_id", "title")


@query("""WITH n AS (SELECT p_partkey AS name, p_name AS title, CASE WHEN p_partkey % 3 > 0 THEN 1950 + p_size END AS year FROM part), i AS (SELECT upper(p_name) AS title, min(p_type) AS genres, min(1950 + p_size) AS year FROM part WHERE p_size < 3 GROUP BY p_name),
y AS (SELECT p_name AS title, 1950 + p_size AS year, max(p_type) AS genres FROM part WHERE p_size BETWEEN 3 AND 30 GROUP BY p_name, p_size)
SELECT name, CASE WHEN i.title IS NOT NULL THEN i.genres ELSE y.genres END AS genres, CASE WHEN i.title IS NOT NULL THEN coalesce(n.year, i.year) ELSE n.year END AS year FROM n LEFT JOIN i ON lower(i.title) = lower(n.title) LEFT JOIN y ON lower(y.title) = lower(n.title) AND y.year = n.year""")
def genre_enrichment(spark, sf_dir):
    """Genres by title, else by title and year."""
    p = table(spark, sf_dir, "part").withColumn("y", 1950 + c("p_size"))
    names = p.select(c("p_partkey").alias("name"), c("p_name").alias("title"), F.when(c("p_partkey") % 3 > 0, c("y")).alias("year"))
    index = p.where("p_size < 3").groupBy("p_name").agg(F.min("p_type").alias("genres"), F.min("y").alias("year")).select(F.upper("p_name").alias("title"), "genres", "year")
    years = p.where("p_size BETWEEN 3 AND 30").groupBy(c("p_name").alias("title"), c("y").alias("year")).agg(F.max("p_type").alias("genres"))
    return op.enriched(names, index, years)


ASSETS = "SELECT p_brand AS subject, CASE p_partkey % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'show' ELSE 'season' END AS kind, CASE WHEN p_partkey % 3 = 2 THEN p_size % 5 END AS season, p_name || '-' || CAST(p_partkey AS STRING) AS name FROM part"


def assets(spark, sf_dir: str) -> DataFrame:
    k = c("p_partkey") % 3
    return table(spark, sf_dir, "part").select(c("p_brand").alias("subject"), F.when(k == 0, "movie").when(k == 1, "show").otherwise("season").alias("kind"), F.when(k == 2, c("p_size") % 5).alias("season"), F.concat("p_name", F.lit("-"), c("p_partkey").cast("string")).alias("name"))


@query(f"""WITH a AS ({ASSETS}) SELECT subject, count(*) AS assets, count(*) FILTER (WHERE kind = 'movie') AS movies, count(*) FILTER (WHERE kind = 'show') AS shows, count(*) FILTER (WHERE kind = 'season') AS seasons,
  list(name ORDER BY CASE kind WHEN 'movie' THEN 1 WHEN 'show' THEN 2 ELSE 3 END, coalesce(season, -1), name) AS names FROM a GROUP BY subject""")
def profile_summary(spark, sf_dir):
    """What each subject gives to the profile, in order."""
    return op.profile_summary(assets(spark, sf_dir))[0]


@query(f"WITH a AS ({ASSETS}) SELECT subject, kind, season, count(*) AS copies FROM a GROUP BY ALL HAVING count(*) > 1")
def profile_duplicates(spark, sf_dir):
    """Groups of assets that a subject gives more than once."""
    return op.profile_summary(assets(spark, sf_dir))[1]


@query("SELECT * FROM (VALUES ('a'), ('b'), ('c'), ('d'), ('e'), ('f')) t(feature) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE CASE feature WHEN 'b' THEN l_linenumber = 1 WHEN 'd' THEN l_quantity > 40 WHEN 'e' THEN l_quantity > 1000 ELSE false END)")
def feature_intersection(spark, sf_dir):
    """The features that both sides of every pair have."""
    f = table(spark, sf_dir, "lineitem")
    side = lambda drop, when: F.map_filter(F.create_map(*[F.lit(x) if i % 2 == 0 else F.lit(1.0) for k in "abcdef" for i, x in enumerate((k, k))]), lambda k, _: ~((k == drop) & when))
    pairs = f.select(side("b", c("l_linenumber") == 1).alias("winner"), F.map_filter(side("d", c("l_quantity") > 40), lambda k, _: ~((k == "e") & (c("l_quantity") > 1000))).alias("loser"))
    return op.shared_features(pairs)


@query("""WITH v AS (SELECT p_partkey, [CASE WHEN p_partkey % 3 > 0 THEN p_size / 50.0 END, CASE WHEN p_partkey % 4 > 0 THEN p_retailprice / 2000.0 END, CASE WHEN p_partkey % 12 > 0 THEN 0.5 END] AS v FROM part)
SELECT p_partkey, round(list_avg(list_filter(v, lambda x: x IS NOT NULL)), 9) AS typicality FROM v""")
def typicality_mean(spark, sf_dir):
    """The mean over the features that have a value."""
    k = c("p_partkey")
    nan = F.lit(float("nan"))
    parts = {"size": F.when(k % 3 > 0, c("p_size") / 50.0), "price": F.when(k % 4 > 0, c("p_retailprice") / 2000.0).otherwise(nan), "flat": F.when(k % 12 > 0, F.lit(0.5))}
    return table(spark, sf_dir, "part").select("p_partkey", F.round(op.mean_typicality(parts), 9).alias("typicality"))


@query("""WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_size * 3.0 END AS l, p_size * 2.0 AS t, p_size * 3.0 + 150 AS r, p_size * 2.0 + 60 AS b, CASE WHEN p_partkey % 7 > 0 THEN 500 ELSE 0 END AS w, 750 AS h FROM part)
SELECT p_partkey, CASE WHEN w > 0 AND l IS NOT NULL THEN round((b - t) / h, 9) END AS title_height_frac, CASE WHEN w > 0 AND l IS NOT NULL THEN round((b + t) / 2 / h, 9) END AS title_y_center, CASE WHEN w > 0 AND l IS NOT NULL THEN round(1 - 2 * abs((l + r) / 2 / w - 0.5), 9) END AS title_centeredness FROM b""")
def title_geometry(spark, sf_dir):
    """A title's size and place in its picture."""
    s = c("p_size").cast("double")
    g = op.title_geometry(F.when(c("p_partkey") % 5 > 0, s * 3), s * 2, s * 3 + 150, s * 2 + 60, F.when(c("p_partkey") % 7 > 0, 500).otherwise(0), F.lit(750))
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(v, 9).alias(k) for k, v in g.items()])


@query("""WITH f AS (SELECT l_orderkey, greatest(0, (l_quantity - 10)) * greatest(0, l_linenumber * 3.0) AS area FROM lineitem) SELECT l_orderkey, count(*) AS face_count, round(max(area) / 60000.0, 9) AS largest_face_frac FROM f GROUP BY l_orderkey""")
def face_geometry(spark, sf_dir):
    """How many faces a picture has and how much of it the largest one takes."""
    box = F.struct(F.lit(10.0).alias("left"), F.lit(0.0).alias("top"), c("l_quantity").alias("right"), (c("l_linenumber") * 3.0).alias("bottom"))
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(box).alias("boxes"))
    g = op.face_geometry(c("boxes"), F.lit(200), F.lit(300))
    return f.select("l_orderkey", g["face_count"].cast("long").alias("face_count"), F.round(g["largest_face_frac"], 9).alias("largest_face_frac"))


@query("""WITH r AS (SELECT p_brand AS subject, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part), s AS (SELECT *, CASE WHEN subject <> 'Brand#3' THEN (rank + 2) // 3 END AS stack_rank, CASE WHEN subject <> 'Brand#3' THEN (rank - 1) % 3 + 1 END AS stack_pos FROM r)
SELECT subject, id FROM s WHERE CASE WHEN subject <> 'Brand#3' THEN stack_pos = 1 AND stack_rank <= 5 ELSE rank <= 5 END""")
def originals_top(spark, sf_dir):
    """The pictures fetched in full: the first of each of the five best stacks, or the five best."""
    r = table(spark, sf_dir, "part").select(c("p_brand").alias("subject"), c("p_partkey").alias("id"), F.row_number().over(Window.partitionBy("p_brand").orderBy(c("p_retailprice").desc(), "p_partkey")).alias("rank"))
    stacked = c("subject") != "Brand#3"
    s = r.withColumns({"stack_rank": F.when(stacked, F.floor((c("rank") + 2) / 3)), "stack_pos": F.when(stacked, (c("rank") - 1) % 3 + 1)})
    return op.heads(s, 5).select("subject", "id")



@query("""WITH m AS (SELECT c_custkey AS movie_id, CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 10 END AS tmdb_id, 'Film ' || CAST(c_custkey % 400 AS STRING) AS title, 1990 + c_custkey % 7 AS year FROM customer),
n AS (SELECT p_partkey AS name, CASE WHEN p_partkey % 4 = 0 THEN p_partkey END AS movie_id, CASE WHEN p_partkey % 5 = 0 THEN p_partkey * 10 END AS tmdb_id, 'FILM ' || CAST(p_partkey % 500 AS STRING) AS title, CASE WHEN p_partkey % 2 = 0 THEN 1990 + p_partkey % 7 END AS year FROM part),
y AS (SELECT lower(title) AS t, year, min(movie_id) AS id FROM m GROUP BY ALL), u AS (SELECT lower(title) AS t, min(movie_id) AS id FROM m GROUP BY 1 HAVING count(*) = 1)
SELECT name, coalesce(CASE WHEN n.tmdb_id IS NOT NULL THEN b.movie_id ELSE a.movie_id END, y.id, u.id) AS movie_id FROM n LEFT JOIN m a ON a.movie_id = n.movie_id LEFT JOIN m b ON b.tmdb_id = n.tmdb_id LEFT JOIN y ON y.t = lower(n.title) AND y.year = n.year LEFT JOIN u ON u.t = lower(n.title)""")
def resolved_titles(spark, sf_dir):
    """Names found by id, by outer id, by title and year, or by a title of its own."""
    k, p = c("c_custkey"), c("p_partkey")
    m = table(spark, sf_dir, "customer").select(k.alias("movie_id"), F.when(k % 3 > 0, k * 10).alias("tmdb_id"), F.concat(F.lit("Film "), (k % 400).cast("string")).alias("title"), (1990 + k % 7).alias("year"))
    n = table(spark, sf_dir, "part").select(p.alias("name"), F.when(p % 4 == 0, p).alias("movie_id"), F.when(p % 5 == 0, p * 10).alias("tmdb_id"), F.concat(F.lit("FILM "), (p % 500).cast("string")).alias("title"), F.when(p % 2 == 0, 1990 + p % 7).alias("year"))
    return op.resolved_titles(n, m)
