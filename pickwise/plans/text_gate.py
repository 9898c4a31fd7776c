"""Queries of the text gate: each part is a picture with four recognised texts, or a row of names along its top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import candidates
from ..operators import text_gate as op
from ..sources.tables import table
from .registry import query

c = F.col

#: What a text reads, whether it belongs to the title "Matrix Reloaded", whether it holds a long word that neither title nor
#: director (Lana Wachowski) explains, its category where its place does not decide (else null), and whether it marks a format.
READ = (
    ("MATRIX RELOADED", True, False, None, False), ("Matrx", True, False, None, False), ("coming soon", False, True, None, False), ("Directed by Lana Wachowski", False, True, "director", False),
    ("Rated R", False, False, "rating", False), ("Netflix", False, True, "studio", False), ("4K Ultra HD", False, True, None, True), ("1999", False, False, None, False),
    ("Season 2", False, True, "season", False), ("all about the very end of everything we knew", False, True, None, False), ("", False, False, "other", False), ("relo", True, False, None, False),
)


def cell(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'"


BOX_SQL = f"""t AS (SELECT * FROM (VALUES {", ".join(f"({i}, {', '.join(cell(x) for x in row)})" for i, row in enumerate(READ))}) v(i, text, title, odd, kind, format)),
b AS (SELECT p_partkey AS image, k AS box_id, 20.0 + (p_partkey % 5) * 40 + k * 30 AS "left", 60.0 + k * 150 + p_size AS top, 20.0 + (p_partkey % 5) * 40 + k * 30 + 30 + p_size * (1 + k % 2) * 2 AS "right", 60.0 + k * 150 + p_size + 12 + p_size % 9 AS bottom,
  CASE WHEN (p_partkey + k) % 7 > 0 THEN 0.9 ELSE 0.5 END AS confidence, (p_partkey * 7 + k * 5) % 12 AS i FROM part, range(0, 4) r(k) WHERE p_partkey % 10 <> 9),
x AS (SELECT b.*, t.* EXCLUDE (i), ("right" - "left") * (bottom - top) AS area, ("left" + "right") / 2 AS cx, (top + bottom) / 2 AS cy FROM b JOIN t USING (i)),
g AS (SELECT image, (min("left") + max("right")) / 2 AS tx, (min(top) + max(bottom)) / 2 AS ty FROM x WHERE title GROUP BY image),
s AS (SELECT x.*, CASE WHEN length(replace(text, ' ', '')) >= 2 AND confidence >= 0.75 AND (area >= 1875 OR "right" - "left" >= 200) THEN CASE WHEN area >= 1875 THEN 'big_area' ELSE 'big_width' END
  WHEN coalesce(sqrt((cx - tx) ** 2 + (cy - ty) ** 2) <= 30, false) THEN NULL WHEN odd THEN 'word_level' END AS significance FROM x LEFT JOIN g USING (image) WHERE NOT title),
k AS (SELECT *, coalesce(kind, CASE WHEN cx / 500 > 0.30 AND cx / 500 < 0.70 AND cy / 750 > 0.05 AND cy / 750 < 0.65 AND i <> 9 THEN 'tagline' WHEN cy / 750 > 0.85 THEN 'billing' ELSE 'other' END) AS category FROM s),
p AS (SELECT p_partkey AS image, EXISTS (SELECT 1 FROM x WHERE x.image = p_partkey AND text <> '') AS has_text, EXISTS (SELECT 1 FROM x WHERE x.image = p_partkey AND format) AS format, EXISTS (SELECT 1 FROM x WHERE x.image = p_partkey AND title) AS has_title FROM part)"""


def boxes(spark, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part").where("p_partkey % 10 <> 9"), c("box_id")
    b = p.select(c("p_partkey").alias("image"), "p_size", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("box_id"))
    text = F.element_at(F.array(*[F.lit(r[0]) for r in READ]), ((c("image") * 7 + k * 5) % 12 + 1).cast("int"))
    left, top = 20.0 + (c("image") % 5) * 40 + k * 30, 60.0 + k * 150 + c("p_size")
    return b.select("image", "box_id", text.alias("text"), F.when((c("image") + k) % 7 > 0, 0.9).otherwise(0.5).alias("confidence"), left.alias("left"), top.alias("top"), (left + 30 + c("p_size") * (1 + k % 2) * 2).alias("right"), (top + 12 + c("p_size") % 9).alias("bottom"), F.lit(True).alias("valid"))


def images(spark, sf_dir: str) -> DataFrame:
    names = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("image"), F.lit(500).alias("width"), F.lit(750).alias("height"), F.lit("Matrix Reloaded").alias("title"), names("matrix", "reloaded").alias("title_tokens"), names("lana", "wachowski").alias("director_tokens"))


@query(f"WITH {BOX_SQL} SELECT image, box_id, 'box' AS source FROM x WHERE title")
def title_evidence(spark, sf_dir):
    """Boxes that are the title or parts of it."""
    return op.title_evidence(boxes(spark, sf_dir), images(spark, sf_dir)).select("image", c("box_id").cast("long").alias("box_id"), "source")


@query(f"WITH {BOX_SQL} SELECT image, box_id, significance FROM s")
def residual_significance(spark, sf_dir):
    """Which of the other texts matter, and why."""
    b, i = boxes(spark, sf_dir), images(spark, sf_dir)
    return op.residuals(b, i, op.title_evidence(b, i)).select("image", c("box_id").cast("long").alias("box_id"), "significance")


@query(f"WITH {BOX_SQL} SELECT image, box_id, category FROM k")
def box_categories(spark, sf_dir):
    """What each text that is not the title is."""
    b, i = boxes(spark, sf_dir), images(spark, sf_dir)
    rest = b.join(op.title_evidence(b, i), ["image", "box_id"], "left_anti")
    return op.categories(rest, i, op.billing_bands(b, i)).select("image", c("box_id").cast("long").alias("box_id"), "category")


def decision_sql(denied: str, reason: str, none: str) -> str:
    return f"""WITH {BOX_SQL}, n AS (SELECT image, count(*) FILTER (WHERE significance IS NOT NULL) AS significant, count(*) FILTER (WHERE significance IS NOT NULL AND {denied}) AS denied, coalesce(sum(area) FILTER (WHERE significance IS NOT NULL AND {denied}), 0) / 375000 AS share FROM k GROUP BY image),
d AS (SELECT p.*, coalesce(significant, 0) AS significant, coalesce(denied, 0) AS denied, coalesce(share, 0.0) AS share FROM p LEFT JOIN n USING (image)), r AS (SELECT *, CASE WHEN NOT has_text THEN {none} WHEN format THEN 'format_blocklist' ELSE {reason} END AS reason FROM d)
SELECT image, reason IS NULL AS accepted, reason, has_title, significant, denied, round(share, 9) AS denied_area FROM r"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("denied_area", F.round("denied_area", 9))


@query(decision_sql("true", "CASE WHEN denied > 1 OR share > 0.04 THEN 'text_heavy' WHEN NOT has_title THEN 'no_title' END", "'no_text'"))
def gate_title_only(spark, sf_dir):
    """Pictures with a title and little else."""
    return rounded(op.decide(boxes(spark, sf_dir), images(spark, sf_dir), "title_only", most_boxes=1))


@query(decision_sql("true", "CASE WHEN has_title THEN 'has_title' WHEN significant > 0 THEN 'text_heavy' END", "NULL"))
def gate_textless(spark, sf_dir):
    """Pictures without title or other text that matters."""
    return rounded(op.decide(boxes(spark, sf_dir), images(spark, sf_dir), "textless"))


@query(decision_sql("category NOT IN ('title', 'director', 'tagline', 'season')", "CASE WHEN denied > 0 OR share > 0.04 THEN 'text_heavy' WHEN NOT has_title THEN 'no_title' END", "'no_text'"))
def gate_custom(spark, sf_dir):
    """Pictures whose text is of allowed kinds: title, director, tagline, season."""
    return rounded(op.decide(boxes(spark, sf_dir), images(spark, sf_dir), "custom", frozenset({"title", "director", "tagline", "season"})))


@query(decision_sql("category NOT IN ('rating', 'studio', 'billing')", "CASE WHEN denied > 2 OR share > 0.5 THEN 'text_heavy' WHEN has_title THEN 'has_title' END", "NULL"))
def gate_custom_without_title(spark, sf_dir):
    """Pictures whose text is of allowed kinds, and has no title; pictures without text pass."""
    return rounded(op.decide(boxes(spark, sf_dir), images(spark, sf_dir), "custom", frozenset({"rating", "studio", "billing"}), most_boxes=2, most_area=0.5, require_title=False))


@query("""WITH b AS (SELECT p_partkey AS image, k AS box_id, 20.0 + k * (20 + p_size * 2) AS l, 40.0 + p_size AS t, 20.0 + k * (20 + p_size * 2) + 30 AS r, 40.0 + p_size + 14 + k * (p_partkey % 6) AS b, CASE WHEN k = 2 AND p_partkey % 5 = 0 THEN 'imax' ELSE 'name' END AS text, CASE WHEN k = 1 AND p_partkey % 7 = 0 THEN 0.5 ELSE 0.8 END AS conf FROM part, range(0, 4) x(k)),
m AS (SELECT * FROM b WHERE conf >= 0.65 AND (t + b) / 2 <= 135 AND text <> 'imax'), g AS (SELECT image, count(*) AS n, max(r) - min(l) AS span, list_sort(list(b - t)) AS tall FROM m GROUP BY image)
SELECT image, box_id FROM m JOIN g USING (image) WHERE n >= 3 AND span >= 140 AND tall[1 + n // 2] <= 41.25 AND tall[-1] / tall[1] <= 1.8""")
def billing_rows(spark, sf_dir):
    """Names along a picture's top."""
    p, k = table(spark, sf_dir, "part"), c("box_id")
    b = p.select(c("p_partkey").alias("image"), "p_size", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("box_id"))
    left, top = 20.0 + k * (20 + c("p_size") * 2), 40.0 + c("p_size")
    text, sure = F.when((k == 2) & (c("image") % 5 == 0), "imax").otherwise("name"), F.when((k == 1) & (c("image") % 7 == 0), 0.5).otherwise(0.8)
    b = b.select("image", "box_id", text.alias("text"), sure.alias("confidence"), left.alias("left"), top.alias("top"), (left + 30).alias("right"), (top + 14 + k * (c("image") % 6)).alias("bottom"), F.lit(True).alias("valid"))
    return op.billing_bands(b, images(spark, sf_dir)).select("image", c("box_id").cast("long").alias("box_id"))


@query(f"""WITH {BOX_SQL}, q AS (SELECT *, CASE WHEN text = 'Season 2' THEN 'season' ELSE was END AS now FROM (SELECT *, CASE box_id WHEN 0 THEN 'other' WHEN 1 THEN 'season' WHEN 2 THEN 'tagline' ELSE 'billing' END AS was, confidence > 0.7 AS sig FROM x)),
a AS (SELECT image, count(*) FILTER (WHERE now <> was) AS changed, count(*) FILTER (WHERE sig AND now NOT IN ('season', 'title')) AS denied, coalesce(sum(area) FILTER (WHERE sig AND now NOT IN ('season', 'title')), 0) / 375000 AS share FROM q GROUP BY image)
SELECT p_partkey AS image, coalesce(changed, 0) AS changed, coalesce(denied, 0) AS denied, round(coalesce(share, 0), 9) AS denied_area, p_partkey % 3 > 0 AND coalesce(denied, 0) <= 2 AND coalesce(share, 0) <= 0.04 AS accepted FROM part LEFT JOIN a ON image = p_partkey""")
def label_replay(spark, sf_dir):
    """Stored decisions taken again under today's rule of seasons."""
    was = F.when(c("box_id") == 0, "other").when(c("box_id") == 1, "season").when(c("box_id") == 2, "tagline").otherwise("billing")
    regions = boxes(spark, sf_dir).withColumns({"category": was, "significant": c("confidence") > 0.7})
    labels = images(spark, sf_dir).select("image", "width", "height", F.when(c("image") % 3 > 0, "custom").otherwise("textless").alias("mode"), F.array(F.lit("season"), F.lit("title")).alias("allow"), F.lit(2).alias("most_boxes"), F.lit(0.04).alias("most_area"))
    return rounded(op.replay(labels, regions))


#: Texts of a season's poster, and what they are for season 2, "The Long Dark".
SEASON_READ = (("Part Two", "season"), ("the complete second season", "season_edition"), ("THE LONG DARK", "season_title"), ("The Lang Dark", "season_title"), ("Season 3", "other"), ("Netflix", "studio"), ("the last season", "season"), ("", "other"))


@query(f"""WITH t AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}')" for i, (_, k) in enumerate(SEASON_READ))}) v(i, category)) SELECT p_partkey AS image, category FROM part JOIN t ON i = p_partkey % {len(SEASON_READ)}""")
def season_box_categories(spark, sf_dir):
    """What the texts of a season's poster are, its own number, edition and title among them."""
    p = table(spark, sf_dir, "part").select(c("p_partkey").alias("image"))
    text = F.element_at(F.array(*[F.lit(t) for t, _ in SEASON_READ]), (c("image") % len(SEASON_READ) + 1).cast("int"))
    b = p.select("image", F.lit(0).alias("box_id"), text.alias("text"), F.lit(0.9).alias("confidence"), F.lit(10.0).alias("left"), F.lit(10.0).alias("top"), F.lit(60.0).alias("right"), F.lit(20.0).alias("bottom"), F.lit(True).alias("valid"))
    out = op.categories(b, images(spark, sf_dir), b.where(F.lit(False)), season=2, season_title="The Long Dark")
    return out.select("image", "category")


def spread(spark, sf_dir: str) -> DataFrame:
    """Pictures whose title is set in single letters: in a line, scrambled in a line, or broken over two lines."""
    p = table(spark, sf_dir, "part").select(c("p_partkey").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("box_id"))
    k, kind = c("box_id"), c("image") % 3
    text = F.when(kind == 0, F.substring(F.lit("MATRIX"), k + 1, F.lit(1))).otherwise(F.substring(F.lit("XIRTA7"), k + 1, F.lit(1)))
    left = F.when(kind == 2, 100.0 + k % 3 * 60).otherwise(60.0 + k * 60)
    top = F.when((kind == 2) & (k >= 3), 160.0).otherwise(100.0)
    return p.select("image", "box_id", text.alias("text"), F.lit(0.9).alias("confidence"), left.alias("left"), top.alias("top"), (left + 40).alias("right"), (top + 50).alias("bottom"), F.lit(True).alias("valid"))


@query("""SELECT p_partkey AS image, CASE WHEN p_partkey % 3 = 0 THEN 'line_window' ELSE 'letter_band' END AS source, 6::BIGINT AS boxes FROM part""")
def spread_title_evidence(spark, sf_dir):
    """Titles in single letters: those of a line together, and bands whose letters stand in any order."""
    return op.title_evidence(spread(spark, sf_dir), images(spark, sf_dir)).groupBy("image", "source").agg(F.count(F.lit(1)).alias("boxes"))


@query("""WITH b AS (SELECT p_partkey AS image, k AS box_id, k * (10 + p_size % 60)::DOUBLE AS l, 0.9 - k / 10.0 AS confidence FROM part, range(0, 4) r(k)), o AS (SELECT x.image, x.box_id AS a, y.box_id AS b, greatest(0, 100 - (y.l - x.l)) / (100 + (y.l - x.l)) >= 0.5 AS over FROM b x JOIN b y ON x.image = y.image AND x.box_id < y.box_id),
k0 AS (SELECT image, 0 AS box_id FROM b WHERE box_id = 0), k1 AS (SELECT image FROM b WHERE box_id = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.image = b.image AND o.a = 0 AND o.b = 1 AND over)),
k2 AS (SELECT image FROM b WHERE box_id = 2 AND NOT EXISTS (SELECT 1 FROM o WHERE o.image = b.image AND o.b = 2 AND over AND (o.a = 0 OR (o.a = 1 AND EXISTS (SELECT 1 FROM k1 WHERE k1.image = b.image))))),
k3 AS (SELECT image FROM b WHERE box_id = 3 AND NOT EXISTS (SELECT 1 FROM o WHERE o.image = b.image AND o.b = 3 AND over AND (o.a = 0 OR (o.a = 1 AND EXISTS (SELECT 1 FROM k1 WHERE k1.image = b.image)) OR (o.a = 2 AND EXISTS (SELECT 1 FROM k2 WHERE k2.image = b.image)))))
SELECT image, 0::BIGINT AS box_id FROM k0 UNION ALL SELECT image, 1 FROM k1 UNION ALL SELECT image, 2 FROM k2 UNION ALL SELECT image, 3 FROM k3""")
def suppressed_boxes(spark, sf_dir):
    """The boxes that stay of four in a row that overlap more or less, the surest first."""
    p, k = table(spark, sf_dir, "part"), c("box_id")
    b = p.select(c("p_partkey").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("box_id"), (10 + c("p_size") % 60).cast("double").alias("step"))
    b = b.select("image", "box_id", (0.9 - k / 10).alias("confidence"), (k * c("step")).alias("left"), F.lit(0.0).alias("top"), (k * c("step") + 100).alias("right"), F.lit(100.0).alias("bottom"))
    return candidates.suppress_overlaps(b).select("image", c("box_id").cast("long").alias("box_id"))
