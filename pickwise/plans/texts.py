"""Text queries over `part`, `customer` and `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, texts
from ..operators.candidates import fuzzy_ratio
from ..sources.tables import table
from .registry import query

c = F.col


@query(r"SELECT doc_id, CAST(length(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS BIGINT) AS chars, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
def text_normalise(spark, sf_dir):
    """The normal form of every text, by length and digest."""
    n = texts.normalise(c("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(n).cast("long").alias("chars"), F.md5(n).alias("digest"))


@query(r"""SELECT p_partkey, len(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda w: length(w) >= 4 AND NOT regexp_full_match(w, '[0-9]+'))) AS significant FROM part""")
def significant_tokens(spark, sf_dir):
    w = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(F.filter(w, texts.significant)).cast("long").alias("significant"))


B, H, U, V = (p.replace("(?i)", "") for p in texts.SECRETS)


@query(rf"""WITH a AS (SELECT doc_id, (CASE doc_id % 4 WHEN 0 THEN 'Authorization: Bearer abc.def x-api-key: k1, ' WHEN 1 THEN 'ftp://user:pass@host/ token=zz& ' WHEN 2 THEN 'hunter2 and hunter22 ' ELSE '' END) || coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, replace(replace(t, 'hunter22', '[REDACTED]'), 'hunter2', '[REDACTED]') AS t, (length(t) - length(replace(t, 'hunter22', ''))) // 8 + (length(replace(t, 'hunter22', '')) - length(replace(replace(t, 'hunter22', ''), 'hunter2', ''))) // 7 AS n FROM a),
b AS (SELECT doc_id, regexp_replace(t, '{B}', '\1[REDACTED]', 'gi') AS t, n + len(regexp_extract_all(t, '{B}', 0, 'i')) AS n FROM k), h AS (SELECT doc_id, regexp_replace(t, '{H}', '\1[REDACTED]', 'gi') AS t, n + len(regexp_extract_all(t, '{H}', 0, 'i')) AS n FROM b),
u AS (SELECT doc_id, regexp_replace(t, '{U}', '\1[REDACTED]@', 'gi') AS t, n + len(regexp_extract_all(t, '{U}', 0, 'i')) AS n FROM h), v AS (SELECT doc_id, regexp_replace(t, '{V}', '\1[REDACTED]', 'gi') AS t, n + len(regexp_extract_all(t, '{V}', 0, 'i')) AS n FROM u)
SELECT doc_id, length(t) AS chars, n AS secrets FROM v""")
def redact_count(spark, sf_dir):
    """Texts with secrets blotted out: their length and how many there were."""
    k = c("doc_id") % 4
    odd = F.when(k == 0, "Authorization: Bearer abc.def x-api-key: k1, ").when(k == 1, "ftp://user:pass@host/ token=zz& ").when(k == 2, "hunter2 and hunter22 ").otherwise("")
    text, n = texts.redact(F.concat(odd, F.coalesce("text", F.lit(""))), ("hunter2", "hunter22"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text).cast("long").alias("chars"), n.alias("secrets"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN lower(CASE WHEN p_partkey % 2 = 0 THEN 'MKV' ELSE p_type END) END AS container FROM part")
def file_container(spark, sf_dir):
    """Files' kinds by their endings."""
    name = F.concat(F.lit("/films/a.b/"), "p_name", F.when(c("p_partkey") % 5 > 0, F.concat(F.lit("."), F.when(c("p_partkey") % 2 == 0, "MKV").otherwise(c("p_type")))).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", texts.container(name).alias("container"))


@query(r"""SELECT n_name, regexp_replace(CASE n_nationkey % 3 WHEN 0 THEN 'The ' WHEN 1 THEN 'a ' ELSE '' END || n_name, '^(?i:the|an|a) ', '') AS key, regexp_replace(CASE n_nationkey % 3 WHEN 0 THEN 'The ' WHEN 1 THEN 'a ' ELSE '' END || n_name, '^((?i:the|an|a)) (.*)$', '\2, \1') AS shown FROM nation""")
def title_sort(spark, sf_dir):
    """Sort keys without articles, and titles with the article behind."""
    n = table(spark, sf_dir, "nation").withColumn("title", F.concat(F.when(c("n_nationkey") % 3 == 0, "The ").when(c("n_nationkey") % 3 == 1, "a ").otherwise(""), c("n_name")))
    return n.select("n_name", texts.sort_key(c("title")).alias("key"), texts.sort_title(c("title")).alias("shown"))


@query(r"""WITH f AS (SELECT p_partkey, p_name || ' (' || (1950 + p_size) || ')' || CASE WHEN p_partkey % 4 = 0 THEN ' ' || (p_partkey % 9 + 1) ELSE '' END || '.jpg' AS file FROM part)
SELECT p_partkey, nullif(regexp_extract(file, '^(.+?) \((\d{4})\)(?:[ _-]*\(?(\d+)\)?)?\.[A-Za-z0-9]+$', 1), '') AS title, CAST(nullif(regexp_extract(file, '^(.+?) \((\d{4})\)(?:[ _-]*\(?(\d+)\)?)?\.[A-Za-z0-9]+$', 2), '') AS INTEGER) AS year,
  CAST(nullif(regexp_extract(file, '^(.+?) \((\d{4})\)(?:[ _-]*\(?(\d+)\)?)?\.[A-Za-z0-9]+$', 3), '') AS INTEGER) AS copy FROM f""")
def filename_parse(spark, sf_dir):
    """Title, year and copy number out of file names."""
    file = F.concat("p_name", F.lit(" ("), (c("p_size") + 1950).cast("string"), F.lit(")"), F.when(c("p_partkey") % 4 == 0, F.concat(F.lit(" "), (c("p_partkey") % 9 + 1).cast("string"))).otherwise(""), F.lit(".jpg"))
    title, year, copy = texts.parse_title(file)
    return table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), year.alias("year"), copy.alias("copy"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN s >= 86400 THEN printf('%dd %dh %dm', s // 86400, s % 86400 // 3600, s % 3600 // 60) WHEN s >= 3600 THEN printf('%dh %dm', s // 3600, s % 3600 // 60) ELSE printf('%dm', s // 60) END AS uptime
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * (l_partkey % 97) * 60 AS s FROM lineitem)""")
def uptime_text(spark, sf_dir):
    s = c("l_quantity").cast("long") * (c("l_partkey") % 97) * 60
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scores.uptime(s).alias("uptime"))


@query("""SELECT p_partkey, CASE WHEN p_size >= 38 THEN '2160p' WHEN p_size >= 19 THEN '1080p' WHEN p_size >= 12 THEN '720p' ELSE 'SD' END AS label, p_size * 100 AS width, p_size * 60 AS height FROM part""")
def resolution_parse(spark, sf_dir):
    """Labels from texts like "1900x1140"."""
    text = F.concat((c("p_size") * 100).cast("string"), F.lit("x"), (c("p_size") * 60).cast("string"))
    width, height = texts.parse_resolution(text)
    return table(spark, sf_dir, "part").select("p_partkey", scores.resolution_label(width).alias("label"), width.alias("width"), height.alias("height"))


#: Texts that name season 2 or do not.
NAMED = ("Season 2", "2nd season", "SEASON TWO", "Part II", "book two", "Vol. 2", "S02", "the final season", "Complete Second Season", "The Complete Season 2", "i liked season 2 best", "Season 12", "Chapter 3", "two")
TEXT_SQL = f"t AS (SELECT p_partkey, [{', '.join(repr(x) for x in NAMED)}][CAST(1 + p_partkey % {len(NAMED)} AS BIGINT)] AS text FROM part), n AS (SELECT p_partkey, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS said FROM t)"


@query(rf"""WITH {TEXT_SQL}, q AS (SELECT p_partkey, said, replace(said, ' ', '') AS x FROM n)
SELECT p_partkey, regexp_full_match(x, '(season|book|part|chapter|volume|vol)(2|2nd|two|second|ii)|(2|2nd|two|second|ii)season|s0?2') OR said IN ('final season', 'last season', 'the final season', 'the last season') AS season,
  regexp_full_match(x, '(the)?complete((2|2nd|two|second|ii)season|season(2|2nd|two|second|ii))') AS edition FROM q""")
def season_mentions(spark, sf_dir):
    """Whether a text as a whole names season 2, or its complete edition."""
    text = F.element_at(F.array(*[F.lit(x) for x in NAMED]), (c("p_partkey") % len(NAMED) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", texts.season_text(text, 2).alias("season"), texts.season_edition(text, 2).alias("edition"))


@query(r"""WITH f AS (SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 3 = 0 THEN '-show.jpg' WHEN s_suppkey % 3 = 1 THEN printf('-season%02d.png', s_suppkey % 12) ELSE '.jpg' END AS file FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN regexp_replace(file, '-(show|season[0-9]+)\.[a-z]+$', '') END AS title, CAST(nullif(regexp_extract(file, '-season([0-9]+)\.', 1), '') AS INTEGER) AS season FROM f""")
def tv_filename_parse(spark, sf_dir):
    """Series' titles and seasons out of artwork names."""
    k = c("s_suppkey")
    file = F.concat("s_name", F.when(k % 3 == 0, "-show.jpg").when(k % 3 == 1, F.format_string("-season%02d.png", k % 12)).otherwise(".jpg"))
    title, season = texts.parse_tv_name(file)
    return table(spark, sf_dir, "supplier").select("s_suppkey", title.alias("title"), season.alias("season"))


@query()
def fuzzy_names(spark, sf_dir):
    """The matching-blocks ratio of each part's name and type."""
    return table(spark, sf_dir, "part").select("p_partkey", fuzzy_ratio(F.lower("p_name"), F.lower("p_type")).alias("ratio"))


@query("""SELECT p_partkey, p_partkey % 5 > 0 AND regexp_matches(replace(lower(p_name), ' ', ''), 'r.*d') AS hit FROM part""")
def letters_in_order(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", texts.subsequence(texts.compact(F.when(c("p_partkey") % 5 > 0, "R d").otherwise("")), texts.compact(c("p_name"))).alias("hit"))
