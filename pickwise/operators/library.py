"""Titles, series and seasons: visibility, reviews, lists, artwork, profiles of what was liked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

# Statuses of a run that wants a decision, and the order of kinds of artwork.
REVIEW_STATUSES = ("completed", "flagged_manual")
KINDS = ("movie", "show", "season")


def wants_review(feedback: Column, status: Column, job: Column, job_phase: Column) -> Column:
    """A run without feedback, in a status that wants a decision, whose job has ended or is not known."""
    return feedback.isNull() & status.isin(*REVIEW_STATUSES) & (job.isNull() | F.coalesce(job_phase == "terminal", F.lit(False)))


def season_downloaded(present: Column, episode_files: Column) -> Column:
    return F.coalesce(present & (episode_files > 0), F.lit(False))


def visible_series(series: DataFrame, seasons: DataFrame) -> DataFrame:
    """Present series with a present season that has files."""
    have = seasons.where(season_downloaded(c("season_present"), c("episode_files"))).select("series_id")
    return series.where("series_present").join(have, "series_id", "left_semi")


def reviews(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """The runs that want a decision; runs(run_job, feedback, status, ...), jobs(job_id, phase)."""
    j = runs.join(jobs.select(c("job_id").alias("_j"), c("phase").alias("_phase")), c("run_job") == c("_j"), "left")
    return j.where(wants_review(c("feedback"), c("status"), c("run_job"), c("_phase"))).drop("_j", "_phase")


def active_file(files: DataFrame) -> DataFrame:
    """movie_id, file_id, size: of a title's active present files the one with the largest id."""
    f = files.where("active AND file_present").groupBy("movie_id").agg(F.max(F.struct("file_id", "size")).alias("f"))
    return f.select("movie_id", "f.file_id", "f.size")


def poster_version(sha: Column, deployed_at: Column) -> Column:
    """What tells one deployed picture from the next: its digest's start, else the second of its deployment, else null."""
    return F.coalesce(F.nullif(F.substring(sha, 1, 16), F.lit("")), F.unix_seconds(deployed_at.cast("timestamp")).cast("string"))


def candidate_id(run: Column, reference: Column, version: str) -> Column:
    """An opaque id of a candidate in a run; the parts are kept apart by NUL."""
    return F.sha2(F.concat(F.lit(version), F.lit("\0"), F.coalesce(run.cast("string"), F.lit("")), F.lit("\0"), reference.cast("string")), 256)


def wide_enough(width: Column, least: int) -> Column:
    """Whether a picture passes the width; one whose width is not known does."""
    return F.lit(True) if least <= 0 else F.coalesce(width >= least, F.lit(True))


def of_namespace(candidates: DataFrame, media_type: str, subject: int, season: int | None = None) -> DataFrame:
    """A subject's candidates in the space of ids of its media type; seasons are told by their series and number."""
    if media_type not in ("movie", "series", "season"):
        raise ValueError(f"unknown media type {media_type}")
    if media_type == "season" and season is None:
        raise ValueError("a season needs its number")
    own = candidates.where((c("media_type") == media_type) & (c("subject") == subject))
    return own.where(c("season") == season) if media_type == "season" else own


def deployed_artwork(series: DataFrame, seasons: DataFrame, files: DataFrame, show_name: str = "poster.jpg", season_name: str = "season%02d.jpg") -> DataFrame:
    """asset_kind, series_id, number, path of shows' and present seasons' pictures that a listing of files holds.

    series(series_id, series_present, folder), seasons(series_id, season_present, number), files(path).
    """
    present = series.where("series_present AND folder IS NOT NULL").select("series_id", "folder")
    shows = present.select(F.lit("show").alias("asset_kind"), "series_id", F.lit(None).cast("int").alias("number"), F.concat("folder", F.lit(f"/{show_name}")).alias("path"))
    own = present.join(seasons.where("season_present"), "series_id").select(F.lit("season").alias("asset_kind"), "series_id", c("number").cast("int"), F.concat("folder", F.lit("/"), F.format_string(season_name, c("number"))).alias("path"))
    return shows.unionByName(own).distinct().join(files.select("path").distinct(), "path", "left_semi").select("asset_kind", "series_id", "number", "path")


def coverage(show_poster: Column, season_posters: Column, seasons: Column, review: Column) -> tuple[Column, Column, Column]:
    """state, present and total of a series' pictures: review, deployed (all), partial, missing; the show's own counts as one."""
    present, total = season_posters + show_poster.isNotNull().cast("int"), seasons + 1
    return F.when(review, "review").when(present == total, "deployed").when(present > 0, "partial").otherwise("missing"), present, total


def heads(ranked: DataFrame, top: int, by: str = "subject") -> DataFrame:
    """The candidates fetched in full: of each of the `top` first stacks its first, or the `top` first of subjects without
    stacks. ranked(by, rank, stack_rank, stack_pos)."""
    some = F.coalesce(F.bool_or(c("stack_rank").isNotNull()).over(Window.partitionBy(by)), F.lit(False))
    place = F.row_number().over(Window.partitionBy(by).orderBy("rank"))
    return ranked.withColumns({"_some": some, "_n": place}).where(F.when(c("_some"), (c("stack_pos") == 1) & (c("stack_rank") <= top)).otherwise(c("_n") <= top)).drop("_some", "_n")


def profile_summary(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By subject: its assets in order of kind, season and name (a bounded number); and the groups of repeated assets.

    assets(subject, kind, season, name).
    """
    order = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), c("kind")), F.lit(0))
    item = F.struct(F.when(order == 0, 10).otherwise(order).alias("o"), F.coalesce("season", F.lit(-1)).alias("s"), c("name").alias("name"))
    subjects = assets.groupBy("subject").agg(F.count(F.lit(1)).alias("assets"), *[F.count_if(c("kind") == k).alias(f"{k}s") for k in KINDS], F.transform(F.sort_array(F.collect_list(item)), lambda x: x["name"]).alias("names"))
    repeated = assets.groupBy("subject", "kind", "season").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return subjects, repeated


def enriched(names: DataFrame, index: DataFrame, year_index: DataFrame) -> DataFrame:
    """name, genres, year: looked up by lower-case title, else by title and year, else none; a name's own year counts first.

    names(name, title, year), index(title, genres, year) and year_index(title, year, genres), one row a key each.
    """
    key = F.lower("title")
    a = index.select(key.alias("_t"), c("genres").alias("_g"), c("year").alias("_y"))
    b = year_index.select(key.alias("_u"), c("year").alias("_v"), c("genres").alias("_h"))
    j = names.join(a, F.lower(names["title"]) == c("_t"), "left").join(b, (F.lower(names["title"]) == c("_u")) & names["year"].eqNullSafe(c("_v")), "left")
    found = c("_t").isNotNull()
    return j.select("name", F.when(found, c("_g")).otherwise(c("_h")).alias("genres"), F.when(found, F.coalesce(names["year"], c("_y"))).otherwise(names["year"]).alias("year"))


def shared_features(pairs: DataFrame, winner: str = "winner", loser: str = "loser") -> DataFrame:
    """feature: those that both sides of every pair have, in order; from maps of features by a count, so no pairs are gathered."""
    n = pairs.agg(F.count(F.lit(1)).alias("_n"))
    both = pairs.select(F.explode(F.array_distinct(F.array_intersect(F.map_keys(winner), F.map_keys(loser)))).alias("feature"))
    return both.groupBy("feature").agg(F.count(F.lit(1)).alias("_k")).join(F.broadcast(n), c("_k") == c("_n")).select("feature").orderBy("feature")


def mean_typicality(values: dict[str, Column]) -> Column:
    """The mean of the features that have a finite typicality; null where none has."""
    v = F.filter(F.array(*values.values()), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v))


def title_geometry(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> dict[str, Column]:
    """A title box's height, place and how central it is, as shares of the picture; null without box or picture."""
    ok = left.isNotNull() & (width > 0) & (height > 0)
    return {
        "title_height_frac": F.when(ok, (bottom - top) / height), "title_y_center": F.when(ok, (bottom + top) / 2 / height),
        "title_centeredness": F.when(ok, 1 - 2 * F.abs((left + right) / 2 / width - 0.5)),
    }


def face_geometry(boxes: Column, width: Column, height: Column) -> dict[str, Column]:
    """How many faces there are and the largest one's share; boxes is an array of structs left, top, right, bottom."""
    area = F.transform(boxes, lambda b: F.greatest(F.lit(0.0), b["right"] - b["left"]) * F.greatest(F.lit(0.0), b["bottom"] - b["top"]))
    ok = (width > 0) & (height > 0)
    return {"face_count": F.when(ok, F.size(boxes)).otherwise(0), "largest_face_frac": F.when(ok, F.coalesce(F.array_max(area), F.lit(0.0)) / (width * height)).otherwise(0.0)}


def resolved_titles(names: DataFrame, movies: DataFrame) -> DataFrame:
    """name, movie_id: by its own id, unless it has a tmdb_id, which then decides; else by title and year (the smallest id),
    else by a title that only one film has. names(name, movie_id, tmdb_id, title, year), movies(movie_id, tmdb_id, title,
    year)."""
    by_tmdb = movies.where("tmdb_id IS NOT NULL").groupBy(c("tmdb_id").alias("_t")).agg(F.max("movie_id").alias("_tm"))
    by_year = movies.groupBy(F.lower("title").alias("_yt"), c("year").alias("_yy")).agg(F.min("movie_id").alias("_ym"))
    by_title = movies.groupBy(F.lower("title").alias("_ut")).agg(F.min("movie_id").alias("_um"), F.count(F.lit(1)).alias("_n")).where("_n = 1")
    n = names.select("name", c("movie_id").alias("_own"), c("tmdb_id").alias("_tmdb"), F.lower("title").alias("_title"), c("year").alias("_year"))
    j = n.join(movies.select(c("movie_id").alias("_i")), c("_own") == c("_i"), "left").join(by_tmdb, c("_tmdb") == c("_t"), "left")
    j = j.join(by_year, (c("_title") == c("_yt")) & (c("_year") == c("_yy")), "left").join(by_title, c("_title") == c("_ut"), "left")
    first = F.when(c("_tmdb").isNotNull(), c("_tm")).otherwise(c("_i"))
    return j.select("name", F.coalesce(first, c("_ym"), c("_um")).alias("movie_id"))
