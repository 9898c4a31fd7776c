"""Stand-in entities: jobs, runs, titles, series and seasons read from the driver tables by arithmetic on their keys.

Each column is one expression that Spark and the checking SQL both understand, so both sides see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

#: Families of four keys: a parent and up to three children.
JOBS = {
    "job_id": "o_orderkey", "parent_id": "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey - o_orderkey % 4 END",
    "type": "CASE o_orderkey % 4 WHEN 0 THEN CASE o_orderkey % 12 WHEN 0 THEN 'batch' WHEN 4 THEN 'tv_batch' ELSE 'heal' END WHEN 1 THEN 'group' ELSE 'item' END",
    "phase": "CASE WHEN o_orderkey % 11 < 8 AND (o_orderkey - o_orderkey % 4) % 3 <> 1 THEN 'terminal' WHEN o_orderstatus = 'P' THEN 'stopping' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'queued' END",
    "ended_as": "CASE (o_custkey + o_orderkey) % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'partially_succeeded' WHEN 2 THEN 'no_change' WHEN 3 THEN 'cancelled' WHEN 4 THEN 'superseded' WHEN 5 THEN 'dead_letter' WHEN 6 THEN 'unsafe' WHEN 7 THEN 'no_change' ELSE 'succeeded' END",
    "failed_count": "CASE WHEN o_custkey % 4 <> 1 THEN o_custkey % 2 END", "cancel_wanted": "o_custkey % 3 = 0", "sealed": "o_custkey % 10 <> 0",
    "level": "CASE o_custkey % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' END", "priority": "CAST(substr(o_orderpriority, 1, 1) AS INT)", "created_at": "o_orderdate",
    "eligible_at": "o_orderdate + INTERVAL 1 DAY", "finished_at": "o_orderdate + INTERVAL 9 DAY", "subject": "o_custkey", "worker": "o_custkey % 5", "selection": "o_custkey % 90",
}
RUNS = {
    "run_id": "o_orderkey", "media_type": "CASE o_orderkey % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'series' ELSE 'season' END", "movie_id": "o_custkey", "series_id": "o_custkey % 90", "season_id": "o_orderkey % 1900",
    "status": "CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'flagged_manual' WHEN o_custkey % 2 = 0 THEN 'running' ELSE 'failed' END",
    "feedback": "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END", "run_job": "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END", "batch_id": "CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey - o_orderkey % 4 END",
    "started_at": "o_orderdate", "completed_at": "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 2 DAY END", "error": "CASE WHEN o_orderkey % 13 = 0 THEN 'earlier' END", "pick": "CASE WHEN o_custkey % 4 <> 0 THEN 'pick.jpg' END",
}
MOVIES = {
    "movie_id": "c_custkey", "title": "CASE WHEN c_custkey % 4 = 0 THEN 'The ' || c_name ELSE c_name END", "year": "1950 + c_custkey % 70", "is_present": "c_acctbal > -500", "own_path": "CASE WHEN c_custkey % 3 = 0 THEN '/films' END",
    "poster_path": "CASE WHEN c_custkey % 5 < 3 THEN '/poster' END", "poster_sha": "CASE WHEN c_custkey % 3 <> 1 THEN c_name || '0123456789abcdef' END", "deployed_at": "CASE WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN CAST('2024-03-01' AS TIMESTAMP) END",
}
FILES = {"file_id": "l_orderkey * 10 + l_linenumber", "movie_id": "l_partkey % 1500", "active": "l_returnflag <> 'R'", "file_present": "l_linestatus = 'O'", "size": "l_quantity"}
SERIES = {"series_id": "s_suppkey", "title": "s_name", "series_present": "s_acctbal > 0", "show_poster": "CASE WHEN s_suppkey % 3 = 0 THEN '/show' END", "tmdb_id": "CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey END"}
SEASONS = {"season_id": "p_partkey", "series_id": "p_partkey % 90", "number": "p_size", "season_present": "p_partkey % 9 <> 0", "episode_files": "p_partkey % 4", "season_poster": "CASE WHEN p_partkey % 5 < 2 THEN '/season' END"}
ENTITIES = {"jobs": ("orders", JOBS), "runs": ("orders", RUNS), "movies": ("customer", MOVIES), "files": ("lineitem", FILES), "series": ("supplier", SERIES), "seasons": ("part", SEASONS)}


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An entity's rows; jobs get their outcome from their phase."""
    source, columns = ENTITIES[name]
    df = table(spark, sf_dir, source).selectExpr(*[f"{v} AS {k}" for k, v in columns.items()])
    if name == "jobs":
        df = df.selectExpr("*", "CASE WHEN phase = 'terminal' THEN ended_as END AS outcome", "CASE WHEN phase = 'terminal' THEN finished_at END AS terminal_at").drop("ended_as", "finished_at")
    return df


def sql(*names: str) -> str:
    """The same entities as common table expressions, for the checking SQL."""
    out = []
    for name in names:
        source, columns = ENTITIES[name]
        rows = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM {source}"
        if name == "jobs":
            rows = f"SELECT *, CASE WHEN phase = 'terminal' THEN ended_as END AS outcome, CASE WHEN phase = 'terminal' THEN finished_at END AS terminal_at FROM ({rows})"
        out.append(f"{name} AS ({rows})")
    return "WITH " + ", ".join(out)
