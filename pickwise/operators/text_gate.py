"""The text gate: which of a picture's recognised texts are its title, what the others are, and whether the picture passes.

boxes(image, box_id, text, confidence, left, top, right, bottom, valid) are a bounded number a picture; images(image, width,
height, title, title_tokens, director_tokens) say what is looked for. Boxes are dealt by picture once and joined to what is
known of it; all else is column functions, and only the matching-blocks ratio of two texts runs in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import compact, normalise, season_edition, season_text, subsequence

c = F.col

# Words that mark a format and a studio.
FORMATS = ("4k", "uhd", "hdr", "bluray", "blu", "ray", "dolby", "atmos", "imax", "dts", "hevc", "remux", "1080p", "2160p", "720p", "ultra", "cinerama", "panavision", "metrocolor")
STUDIOS = ("paramount", "warner", "bros", "disney", "universal", "sony", "columbia", "lionsgate", "mgm", "netflix", "a24", "focus", "features", "dreamworks", "pixar", "searchlight", "miramax", "orion", "touchstone", "blumhouse", "legendary")
# Forms of certificates and of seasons' names.
RATING = r"\b(rated\s+)?(g|pg|pg-13|nc-17|r|nr|unrated|not\s*rated)\b"
SEASONS = (
    r"season\s*\d{1,3}", r"s\d{1,2}", r"\d{1,2}(?:st|nd|rd|th)?\s+season", r"(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\s+season", r"season\s+(?:one|two|three|four|five|six|seven|eight|nine|ten)",
    r"(?:the\s+)?(?:final|last)\s+season", r"part\s+(?:\d{1,2}|one|two|three|four|five|six)", r"vol(?:ume)?\s*\d{1,2}", r"book\s+\w+", r"chapter\s+\w+", r"[ivxlc]{1,4}", r"\d{1,2}",
)
# Thresholds of matching, of geometry and of bands.
FUZZY, COMPACT_FUZZY, CLUSTER_FUZZY, TAGLINE_FUZZY, SEASON_FUZZY = 0.60, 0.72, 0.80, 0.70, 0.82
CONFIDENT, STRIP_CONFIDENT = 0.75, 0.65
BIG_AREA, BIG_WIDTH, NEAR_TITLE = 0.005, 0.40, 30.0
BAND_BOXES, BAND_WIDTH, BAND_HEIGHT, BAND_CHARS, BAND_GAP = 3, 0.18, 0.035, 4, 1.2
BAND_SHARES = ((0.55, 0.55), (0.40, 0.80))  # of the title's letters, and of the band's
BILLING_STRIP, BILLING_BOXES, BILLING_WIDTH, BILLING_HEIGHT, BILLING_SPREAD = 0.18, 3, 0.28, 0.055, 1.8


def words(text: Column) -> Column:
    return F.filter(F.split(normalise(text), " "), lambda w: w != "")


def ratio(p: str, q: str, least: float) -> float:
    """The matching-blocks ratio of two texts, which depends on which comes first; 0 where lengths or letters show that it is below `least`."""
    m = SequenceMatcher(None, p, q)
    return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0


def ratios(texts: Column, others: Column, least: float) -> Column:
    """For each text its matching-blocks ratio to each of others (ratios below `least` may be given as 0)."""

    @F.arrow_udf("array<array<double>>")
    def run(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = lru_cache(100_000)(lambda p, q: ratio(p, q, least))
        for a, b in it:
            rows = [[[0.0 if x is None or y is None else known(x, y) for y in ys or ()] for x in xs or ()] for xs, ys in zip(a.to_pylist(), b.to_pylist(), strict=True)]
            yield pa.array(rows, pa.list_(pa.list_(pa.float64())))

    return run.asNondeterministic()(texts, others)  # a column of its own: lambdas that name it cannot hold it


def one_ratio(text: Column, other: Column, least: float) -> Column:
    return ratios(F.array(text), F.array(other), least)[0][0]


def near(texts: Column, others: Column, others_first: bool) -> Column:
    """The texts whose matching-blocks ratio to one of others reaches FUZZY."""

    @F.arrow_udf("array<string>")
    def run(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = lru_cache(100_000)(lambda p, q: ratio(p, q, FUZZY) >= FUZZY)
        hit = lambda x, y: x is not None and y is not None and (known(y, x) if others_first else known(x, y))
        for a, b in it:
            rows = [[x for x in xs or () if any(hit(x, y) for y in ys or ())] for xs, ys in zip(a.to_pylist(), b.to_pylist(), strict=True)]
            yield pa.array(rows, pa.list_(pa.string()))

    return run.asNondeterministic()(texts, others)  # a column of its own: lambdas that name it cannot hold it


def surely(word: Column, token: Column) -> Column:
    """Whether a token explains a word without measuring: equal, or one of three letters at least inside the other."""
    sure = (word == token) | ((F.length(token) >= 3) & word.contains(token)) | ((F.length(word) >= 3) & token.contains(word))
    return F.coalesce(sure, F.lit(False))


def unexplained(df: DataFrame, own: Column, tokens: Column, name: str) -> DataFrame:
    """Adds the distinct words of `own` that no token explains: surely, or by being near. Nearness is measured only where the rest says no."""
    df = df.withColumns({"_tokens": F.coalesce(tokens, F.array().cast("array<string>")), "_words": own})
    df = df.withColumn("_rest", F.filter(F.array_distinct("_words"), lambda w: ~F.exists("_tokens", lambda t: surely(w, t))))
    df = df.withColumn("_near", near(c("_rest"), F.when(F.size("_rest") > 0, c("_tokens")), True))
    return df.withColumn(name, F.array_except("_rest", "_near")).drop("_tokens", "_words", "_rest", "_near")


def mostly_named(df: DataFrame, keys: list[str], text: str, tokens: str) -> DataFrame:
    """keys of texts in which half of the tokens or more stand."""
    return with_named(df, text, tokens, "_named").where("_named").select(*keys)


def with_named(df: DataFrame, text: str, tokens: str, name: str) -> DataFrame:
    """Adds whether half of the tokens or more stand in a text (those of three letters or more, if there are any), and it
    has not many words besides."""
    long = F.filter(c(tokens), lambda t: F.length(t) > 2)
    df = df.withColumns({"_w": words(c(text)), "_t": F.array_distinct(F.when(F.size(long) > 0, long).otherwise(c(tokens)))})
    df = df.withColumn("_fits", F.coalesce((F.size("_w") > 0) & (F.size("_t") > 0) & (F.size("_w") <= F.size("_t") + 5), F.lit(False)))
    df = df.withColumn("_rest", F.when(c("_fits"), F.filter("_t", lambda t: ~F.exists("_w", lambda w: surely(w, t)))))
    df = df.withColumn("_near", near(c("_rest"), F.when(F.size("_rest") > 0, c("_w")), False))
    hits = F.size("_t") - F.size(F.array_except("_rest", "_near"))
    return df.withColumn(name, F.coalesce(c("_fits") & (hits >= F.greatest(F.lit(1), F.floor((F.size("_t") + 1) / 2))), F.lit(False))).drop("_w", "_t", "_fits", "_rest", "_near")


#: How letters without spaces may stand for the title or one of its words, one rule a row: for which targets (title, word or
#: both), only in rows of single letters or always, least letters of the text and of the target, the text's least and most
#: share of the target's letters after taking off spare ones, and the test.
RULES = (
    ("both", False, 2, 1, 1.00, 1.00, 0, "equal"), ("title", False, 3, 1, 0.00, 1.00, 0, "inside"), ("word", False, 3, 3, 0.00, 1.00, 0, "inside"),
    ("title", False, 4, 1, 0.35, 1.15, 0, COMPACT_FUZZY), ("word", False, 3, 3, 0.40, 1.10, 0, COMPACT_FUZZY), ("title", False, 4, 1, 0.35, 1.00, 0, "order"), ("word", False, 4, 3, 0.55, 1.00, 0, "order"),
    ("both", True, 3, 3, 0.50, 1.00, 1, "order"), ("both", True, 3, 3, 0.75, 1.00, 1, CLUSTER_FUZZY),
)


def matches_title(text: Column, title: Column, tokens: Column, to_tokens: Column, to_title: Column, cluster: Column | None = None) -> Column:
    """Whether letters without spaces stand for the title or one of its words by one of RULES.

    to_tokens and to_title are the ratios to each token and to the title; `cluster` tells rows of single letters.
    """
    n = F.length(text)
    of_title = F.struct(F.lit(True).alias("whole"), title.alias("t"), to_title.alias("r"))
    of_words = F.transform(tokens, lambda t, i: F.struct(F.lit(False).alias("whole"), t.alias("t"), F.get(to_tokens, i).alias("r")))
    # What the rules ask of a target, told once.
    told = lambda x: F.struct(x["whole"].alias("whole"), F.length(x["t"]).alias("size"), x["r"].alias("r"), (x["t"] == text).alias("equal"), x["t"].contains(text).alias("inside"), subsequence(text, x["t"]).alias("order"))

    def meets(x: Column) -> Column:
        size, out = x["size"], F.lit(False)
        for who, rows_only, letters, least, low, high, spare, test in RULES:
            if rows_only and cluster is None:
                continue
            fits = (n >= letters) & (size >= least) & (n / size >= low) & ((n - spare) / size <= high)
            fits = fits & (x[test] if isinstance(test, str) else x["r"] >= test)
            fits = fits if who == "both" else fits & (x["whole"] if who == "title" else ~x["whole"])
            out = out | (fits & cluster if rows_only else fits)
        return out

    targets = F.filter(F.concat(F.array(of_title), of_words), lambda x: F.length(x["t"]) > 0)
    return F.coalesce(F.exists(F.transform(targets, told), meets), F.lit(False))


LINE = "array<struct<total:double,tall:double,ids:array<{0}>>>"  # a line's sum of centres, its tallest box, its boxes


def lines(boxes: Column, kind: str, height: Column) -> Column:
    """The lines of a picture's boxes (an array of structs y, x, box_id, tall, in that order): a fold over the boxes from the
    top down, in which a box joins the first line that it is level with, or opens one.

    Level: the box's centre and the line's mean one differ by no more than 0.7 of the tallest box of both, or 0.018 of the
    picture's height.
    """
    reach = lambda a, b: F.greatest(height * 0.018, F.greatest(a, b) * 0.70)
    line = lambda total, tall, ids: F.struct(total.alias("total"), tall.alias("tall"), ids.alias("ids"))

    def take(found: Column, box: Column) -> Column:
        y, tall, own = box["y"], F.greatest(F.lit(1.0), box["tall"]), F.array(box["box_id"])
        level = F.transform(found, lambda k: F.abs(y - k["total"] / F.size(k["ids"])) <= reach(tall, k["tall"]))
        at = F.array_position(level, True)
        joined = F.transform(found, lambda k, i: F.when(i + 1 == at, line(k["total"] + y, F.greatest(k["tall"], tall), F.concat(k["ids"], own))).otherwise(k))
        return F.when(at > 0, joined).otherwise(F.concat(found, F.array(line(y, tall, own))))

    return F.aggregate(F.sort_array(boxes), F.array().cast(LINE.format(kind)), take)


def lined(boxes: Column, kind: str, height: Column) -> Column:
    """The same of structs box_id, left, top, right, bottom."""
    box = lambda x: F.struct(((x["top"] + x["bottom"]) / 2).alias("y"), ((x["left"] + x["right"]) / 2).alias("x"), x["box_id"].alias("box_id"), (x["bottom"] - x["top"]).cast("double").alias("tall"))
    return lines(F.transform(boxes, box), kind, height.cast("double"))


def same_lines(boxes: DataFrame) -> DataFrame:
    """image, box_id, line of boxes(image, box_id, left, top, right, bottom, height); lines count from 0 in order of their first boxes."""
    g = boxes.groupBy("image").agg(F.collect_list(F.struct("box_id", "left", "top", "right", "bottom")).alias("b"), F.first("height").alias("h"))
    found = g.select("image", F.posexplode(lined(c("b"), dict(boxes.dtypes)["box_id"], c("h"))).alias("line", "own"))
    return found.select("image", F.explode("own.ids").alias("box_id"), "line")


def with_picture(boxes: DataFrame, images: DataFrame, how: str = "inner") -> DataFrame:
    """boxes with columns of their picture. Boxes are dealt by picture, so all later steps of a picture stay where it is;
    neither side is small enough to be sent whole to all workers, whatever the size of its files."""
    return boxes.join(images.hint("merge"), "image", how)


def dealt(boxes: DataFrame) -> DataFrame:
    """boxes by picture, in as many parts as the session shuffles to: a picture is few bytes but much work, so parts are not merged by their bytes."""
    return boxes.repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image")


def looked_for(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """boxes with their picture's size, title and tokens, and the letters of text and title without spaces."""
    letters = F.array_distinct(F.filter(F.transform("title_tokens", compact), lambda t: t != ""))
    i = images.select("image", "width", "height", "title_tokens", "director_tokens", F.coalesce(compact(c("title")), F.lit("")).alias("title_letters"), letters.alias("token_letters"))
    return with_picture(dealt(boxes), i).withColumn("letters", F.coalesce(compact(c("text")), F.lit("")))


BOX = ("box_id", "text", "letters", "confidence", "left", "top", "right", "bottom", "valid")
PICTURE = ("width", "height", "title_tokens", "title_letters", "token_letters")


def by_picture(b: DataFrame) -> DataFrame:
    """One row a picture of looked_for: its boxes (a bounded number) as the array `b`."""
    return b.groupBy("image").agg(F.collect_list(F.struct(*BOX)).alias("b"), *[F.first(k).alias(k) for k in PICTURE])


def most(xs: Column, name: str) -> Column:
    return F.array_max(F.transform(xs, lambda x: x[name]))


def least(xs: Column, name: str) -> Column:
    return F.array_min(F.transform(xs, lambda x: x[name]))


def members(line: Column, boxes: Column) -> Column:
    return F.filter(boxes, lambda x: F.array_contains(line["ids"], x["box_id"]))


def middle(talls: Column) -> Column:
    return F.get(F.sort_array(talls), F.floor(F.size(talls) / 2).cast("int"))


def banded(p: DataFrame, kind: str) -> DataFrame:
    """Adds to by_picture the box_ids of letter_bands as `bands`."""
    alpha = lambda t: F.array_distinct(F.filter(F.split(t, ""), lambda ch: ch.rlike("^[a-z]$")))
    none = F.array().cast(f"array<{kind}>")
    glyph = F.filter("b", lambda x: F.coalesce(x["valid"] & (x["confidence"] >= CONFIDENT) & F.length(x["letters"]).between(1, BAND_CHARS), F.lit(False)))
    p = p.withColumn("_glyphs", F.transform(glyph, lambda x: F.struct(*[x[k].alias(k) for k in ("box_id", "left", "top", "right", "bottom")], (x["bottom"] - x["top"]).alias("tall"), alpha(x["letters"]).alias("signs"))))
    # Pictures with too few glyphs have no band.
    p = p.withColumn("_lines", F.when(F.size("_glyphs") >= BAND_BOXES, lined(c("_glyphs"), kind, c("height"))))
    told = lambda own, nth: F.struct(
        F.aggregate(F.transform(own, lambda x: (x["top"] + x["bottom"]) / 2), F.lit(0.0), lambda s, y: s + y, lambda s: s / F.size(own)).alias("y"), nth.alias("line"), least(own, "top").alias("top"), most(own, "bottom").alias("bottom"), least(own, "left").alias("left"),
        most(own, "right").alias("right"), F.flatten(F.transform(own, lambda x: x["signs"])).alias("signs"), F.transform(own, lambda x: x["tall"]).alias("talls"), F.transform(own, lambda x: x["box_id"]).alias("ids"),
    )
    own = F.transform("_lines", lambda k: members(k, c("_glyphs")))
    p = p.withColumn("_own", own).withColumn("_rows", F.sort_array(F.transform("_own", told)))
    targets = F.transform(F.filter(F.concat(F.array("title_letters"), "token_letters"), lambda t: F.length(t) >= 2), alpha)
    p = p.withColumn("_targets", F.filter(targets, lambda t: F.size(t) > 0))
    # Every run of a picture's rows (whose boxes are few), with what each adds below those before it.
    cut = lambda a, z: F.slice("_rows", a, z - a + 1)
    run = lambda a, z: F.struct(
        F.flatten(F.transform(cut(a, z), lambda r: r["talls"])).alias("talls"), F.array_distinct(F.flatten(F.transform(cut(a, z), lambda r: r["signs"]))).alias("signs"), (most(cut(a, z), "right") - least(cut(a, z), "left")).alias("span"),
        F.flatten(F.transform(cut(a, z), lambda r: r["ids"])).alias("ids"), (F.get("_rows", z - 1)["top"] - F.when(z > a, most(F.slice("_rows", a, F.greatest(z - a, F.lit(0))), "bottom"))).alias("gap"),
    )
    n = F.size("_rows")
    starts = F.when(n > 0, F.sequence(F.lit(1), n))
    p = p.withColumn("_runs", F.transform(starts, lambda a: F.transform(F.sequence(a, n), lambda z: run(a, z))))
    near_ = lambda r: F.coalesce(r["gap"] <= BAND_GAP * middle(r["talls"]), F.lit(True))
    # Of the runs that begin at a row those up to the first that does not lie close below.
    whole = lambda rs: F.slice(rs, F.lit(1), F.aggregate(rs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, r: F.struct((s["n"] + (s["on"] & near_(r)).cast("int")).alias("n"), (s["on"] & near_(r)).alias("on")), lambda s: s["n"]))
    p = p.withColumn("_runs", F.flatten(F.transform("_runs", whole)))
    p = p.withColumn("_runs", F.filter("_runs", lambda r: (F.size(r["talls"]) >= BAND_BOXES) & (r["span"] >= c("width") * BAND_WIDTH) & (middle(r["talls"]) >= c("height") * BAND_HEIGHT) & (F.size(r["signs"]) > 0)))
    common = lambda r, t: F.size(F.array_intersect(r["signs"], t))
    best = lambda r: F.array_max(F.transform("_targets", lambda t, i: F.struct((common(r, t) / F.size(t)).alias("covers"), (-i).alias("nth"), (common(r, t) / F.size(r["signs"])).alias("own"))))
    p = p.withColumn("_runs", F.transform("_runs", lambda r: F.struct(r["ids"].alias("ids"), best(r).alias("best"))))
    good = lambda x: F.coalesce(reduce(lambda u, v: u | v, [(x["covers"] >= covers) & (x["own"] >= own_) for covers, own_ in BAND_SHARES]), F.lit(False))
    ids = F.array_distinct(F.flatten(F.transform(F.filter("_runs", lambda r: good(r["best"])), lambda r: r["ids"])))
    return p.withColumn("bands", F.coalesce(ids, none)).drop("_glyphs", "_lines", "_own", "_rows", "_targets", "_runs")


def letter_bands(b: DataFrame) -> DataFrame:
    """image, box_id of widely set titles: wide rows (or rows close below each other) of large single glyphs whose letters
    are much of the title's, and the title's much of theirs.

    Rows from a first to a last one are a band if each but the first lies close below those before it.
    """
    return banded(by_picture(b), dict(b.dtypes)["box_id"]).select("image", F.explode("bands").alias("box_id"))


def title_boxes(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """image, found: for each picture with boxes the array of those of its title, as structs box_id, source (see title_evidence)."""
    kind, b = dict(boxes.dtypes)["box_id"], looked_for(boxes, images)
    p = by_picture(b).withColumn("_said", F.transform("b", lambda x: words(x["text"])))
    p = unexplained(p, F.flatten(F.filter("_said", lambda w: w.isNotNull())), c("title_tokens"), "_odd")
    valid = F.filter("b", lambda x: x["valid"])
    p = p.withColumn("_lines", F.filter(lined(valid, kind, c("height")), lambda k: F.size(k["ids"]) > 1))
    in_row = lambda own: F.sort_array(F.transform(own, lambda x: F.struct(((x["left"] + x["right"]) / 2).alias("x"), x["box_id"].alias("box_id"), x["letters"].alias("letters"), x["left"].alias("left"), x["right"].alias("right"))))
    p = p.withColumn("_row", F.transform("_lines", lambda k: in_row(members(k, c("b")))))
    cut = lambda row: F.flatten(F.transform(F.sequence(F.lit(0), F.size(row) - 2), lambda i: F.transform(F.sequence(F.lit(2), F.least(F.lit(8), F.size(row) - i)), lambda n: F.slice(row, i + 1, n))))
    p = p.withColumn("_w", F.flatten(F.transform("_row", cut)))
    text = lambda letters, ids, cluster: F.struct(letters.alias("letters"), ids.alias("ids"), cluster.alias("cluster"))
    signs = lambda w: F.transform(w, lambda x: x["letters"])
    window = lambda w: text(F.array_join(signs(w), ""), F.transform(w, lambda x: x["box_id"]), F.forall(w, lambda x: F.length(x["letters"]) <= 2) & (most(w, "right") - least(w, "left") >= c("width") * BAND_WIDTH))
    p = p.withColumn("_texts", F.concat(F.transform("_w", window), F.transform("b", lambda x: text(x["letters"], F.array(x["box_id"]), F.lit(False)))))
    p = p.withColumn("_r", ratios(F.transform("_texts", lambda t: t["letters"]), F.concat("token_letters", F.array("title_letters")), COMPACT_FUZZY))
    hit = lambda t, r: matches_title(t["letters"], c("title_letters"), c("token_letters"), r, F.get(r, F.size("token_letters")), t["cluster"])
    p = p.withColumn("_hits", F.filter(F.zip_with("_texts", "_r", lambda t, r: F.struct(t["ids"].alias("ids"), hit(t, r).alias("hit"))), lambda x: x["hit"]))
    p = banded(p, kind)
    ids = lambda several: F.flatten(F.transform(F.filter("_hits", lambda x: (F.size(x["ids"]) > 1) == several), lambda x: x["ids"]))
    p = p.withColumns({"_windows": ids(F.lit(True)), "_singles": ids(F.lit(False))})
    # Told once a picture, not once a box.
    known = F.struct(c("_windows").alias("windows"), c("_singles").alias("singles"), c("bands").alias("bands"), c("_odd").alias("odd"), c("_said").alias("said"))
    by_words = lambda k, i: F.coalesce((F.size(F.get(k["said"], i)) > 0) & ~F.arrays_overlap(F.get(k["said"], i), k["odd"]), F.lit(False))
    source = lambda k, x, i: F.when(F.array_contains(k["windows"], x["box_id"]), "line_window").when(by_words(k, i) | F.array_contains(k["singles"], x["box_id"]), "box").when(F.array_contains(k["bands"], x["box_id"]), "letter_band")
    of = lambda k: F.filter(F.transform("b", lambda x, i: F.struct(x["box_id"].alias("box_id"), source(k, x, i).alias("source"))), lambda x: x["source"].isNotNull())
    found = F.transform(F.array(known), of)[0]
    return p.select("image", found.alias("found"))


def title_evidence(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """image, box_id, source of the boxes that belong to the title: by the letters of two to eight boxes of a line together
    (line_window), by their own text (box), or as a band of single letters (letter_band); the first that holds is told."""
    return title_boxes(boxes, images).select("image", F.explode("found").alias("s")).select("image", "s.box_id", "s.source")


def of_formats(text: Column) -> Column:
    return F.arrays_overlap(words(text), F.array(*[F.lit(f) for f in FORMATS]))


def billing_bands(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """image, box_id of rows of names along the top: three or more small boxes of like height over much of the width."""
    kind, p = dict(boxes.dtypes)["box_id"], by_picture(looked_for(boxes, images))
    top = F.filter("b", lambda x: F.coalesce(x["valid"] & (x["confidence"] >= STRIP_CONFIDENT) & ((x["top"] + x["bottom"]) / 2 <= c("height") * BILLING_STRIP) & (x["letters"] != ""), F.lit(False)))
    p = p.withColumn("_top", top).where(F.size("_top") >= BILLING_BOXES)
    p = p.withColumn("_lines", F.filter(lined(c("_top"), kind, c("height")), lambda k: F.size(k["ids"]) >= BILLING_BOXES)).withColumn("_top", F.filter("_top", lambda x: ~of_formats(x["text"])))
    talls = lambda own: F.transform(own, lambda x: F.greatest(F.lit(1.0), x["bottom"] - x["top"]))
    wide = lambda own: (F.size(own) >= BILLING_BOXES) & (most(own, "right") - least(own, "left") >= c("width") * BILLING_WIDTH)
    low = lambda own: (middle(talls(own)) <= c("height") * BILLING_HEIGHT) & (F.array_max(talls(own)) / F.array_min(talls(own)) <= BILLING_SPREAD)
    p = p.withColumn("_rows", F.transform("_lines", lambda k: members(k, c("_top"))))
    return p.select("image", F.explode(F.flatten(F.filter("_rows", lambda own: wide(own) & low(own)))).alias("x")).select("image", "x.box_id")


def ids_of(found: DataFrame, name: str) -> DataFrame:
    """image, and the box_ids of its rows (a bounded number) as an array."""
    return found.groupBy("image").agg(F.collect_list("box_id").alias(name))


def weighed(boxes: DataFrame, images: DataFrame, found: DataFrame) -> DataFrame:
    """All boxes with their picture's size and tokens and, of found(image, _own: its title's box_ids), of_title, area, significance and near_title."""
    i = images.select("image", "width", "height", "title_tokens", "director_tokens")
    b = with_picture(with_picture(dealt(boxes), i), found, "left").withColumn("of_title", F.coalesce(F.array_contains("_own", c("box_id")), F.lit(False)))
    own, all_ = lambda x: F.when(c("of_title"), c(x)), Window.partitionBy("image")
    b = b.withColumns({"_x": (F.min(own("left")).over(all_) + F.max(own("right")).over(all_)) / 2, "_y": (F.min(own("top")).over(all_) + F.max(own("bottom")).over(all_)) / 2, "area": (c("right") - c("left")) * (c("bottom") - c("top"))})
    b = unexplained(b, F.when(~c("of_title"), words(c("text"))), F.array_union("title_tokens", "director_tokens"), "_odd")
    odd = F.exists("_odd", lambda w: (F.length(w) >= 4) & ~w.rlike("^[0-9]+$"))
    wide = c("area") >= BIG_AREA * c("width") * c("height")
    big = (F.length(F.coalesce(compact(c("text")), F.lit(""))) >= 2) & c("valid") & (c("confidence") >= CONFIDENT) & (wide | (c("right") - c("left") >= BIG_WIDTH * c("width")))
    far = F.hypot((c("left") + c("right")) / 2 - c("_x"), (c("top") + c("bottom")) / 2 - c("_y"))
    near_title = ~c("of_title") & ~big & F.coalesce(far <= NEAR_TITLE, F.lit(False))
    why = F.when(~c("of_title"), F.when(big, F.when(wide, "big_area").otherwise("big_width")).when(~near_title & odd, "word_level"))
    return b.withColumns({"significance": why, "near_title": near_title}).drop("_own", "_x", "_y", "_odd")


def residuals(boxes: DataFrame, images: DataFrame, evidence: DataFrame) -> DataFrame:
    """Boxes that are not of the title, with area, significance (null: none) and near_title (left out for its nearness).

    Large confident boxes are significant whatever was read; small ones near the title are not; of the rest those are that
    hold a word of four letters or more that neither title nor director explain.
    """
    return weighed(boxes, images, ids_of(evidence, "_own")).where(~c("of_title")).select(*boxes.columns, "area", "significance", "near_title")


def categories(boxes: DataFrame, images: DataFrame, billing: DataFrame, tagline: str | None = None, season: int | None = None, season_title: str | None = None) -> DataFrame:
    """image, box_id, category of boxes: season, season_edition, season_title, billing, director, rating, studio, tagline or
    other, by the first rule that fits. `tagline`, and the season's number and title, hold for all pictures; without a
    number any season's name counts. A box without words is other."""
    i = images.select("image", "width", "height", "director_tokens")
    return categorised(with_picture(dealt(boxes), i), billing, tagline, season, season_title).select("image", "box_id", "category")


def categorised(b: DataFrame, billing: DataFrame, tagline: str | None, season: int | None, season_title: str | None) -> DataFrame:
    """Adds the category to boxes that have their picture's width, height and director_tokens."""
    j = with_picture(b, ids_of(billing, "_billed"), "left").withColumns({"_band": F.array_contains("_billed", c("box_id")), "letters": F.coalesce(compact(c("text")), F.lit(""))})
    j = with_named(j, "text", "director_tokens", "_named")
    text, w = normalise(c("text")), words(c("text"))
    x, y = (c("left") + c("right")) / 2 / c("width"), (c("top") + c("bottom")) / 2 / c("height")
    said = F.lit("".join(ch for ch in (tagline or "").lower() if ch.isascii() and ch.isalnum()))
    slogan = (F.length(said) > 0) & (c("letters") != "") & (one_ratio(c("letters"), said, TAGLINE_FUZZY) >= TAGLINE_FUZZY) if tagline else F.lit(False)
    numbered = text.rlike(f"^(?:{'|'.join(SEASONS)})$") if season is None else season_text(c("text"), season)
    packed = F.lit(False) if season is None else season_edition(c("text"), season)
    own = "".join(ch for ch in (season_title or "").lower() if ch.isascii() and ch.isalnum())
    called = (c("letters") == own) | (one_ratio(c("letters"), F.lit(own), SEASON_FUZZY) >= SEASON_FUZZY) if own else F.lit(False)
    rule = (
        F.when(F.coalesce(F.size(w), F.lit(0)) == 0, "other").when(numbered, "season").when(packed, "season_edition").when(called, "season_title").when(c("_band"), "billing")
        .when(F.lower("text").rlike(r"directed\s+by") | c("_named"), "director").when(text.rlike(RATING), "rating")
        .when(F.arrays_overlap(w, F.array(*[F.lit(s) for s in STUDIOS])), "studio").when(slogan, "tagline")
        .when((x > 0.30) & (x < 0.70) & (y > 0.05) & (y < 0.65) & (F.size(F.array_distinct(w)) <= 8), "tagline").when(y > 0.85, "billing").otherwise("other")
    )
    return j.withColumn("category", rule).drop("_billed", "_band", "_named", "letters")


def decide(boxes: DataFrame, images: DataFrame, mode: str, allow: frozenset[str] = frozenset({"title"}), most_boxes: int = 0, most_area: float = 0.04, require_title: bool = True, tagline: str | None = None, season: int | None = None, season_title: str | None = None) -> DataFrame:
    """image, accepted, reason, has_title, significant, denied, denied_area of every picture, boxes or not.

    title_only: a title, and no more significant other text than allowed. textless: neither title nor significant text.
    custom: significant text of the categories in `allow` does not count. A format mark rejects a picture in every mode; a
    picture without any text passes if it is to be textless, or may be.
    """
    every = weighed(boxes, images, title_boxes(boxes, images).select("image", c("found.box_id").alias("_own")))
    counts = c("significance").isNotNull()
    if mode == "custom":
        every = categorised(every, billing_bands(boxes, images), tagline, season, season_title)
        denied_box = counts & ~c("category").isin(*allow)
    else:
        denied_box = counts
    some = F.size(words(c("text"))) > 0
    sums = every.groupBy("image").agg(F.bool_or(F.when(some, of_formats(c("text")))).alias("_format"), F.bool_or("of_title").alias("_title"), F.count_if(counts).alias("_sig"), F.count_if(denied_box).alias("_den"), F.sum(F.when(denied_box, c("area"))).alias("_area"))
    j = with_picture(images.select("image", "width", "height"), sums, "left")
    has, significant, denied = F.coalesce("_title", F.lit(False)), F.coalesce("_sig", F.lit(0)), F.coalesce("_den", F.lit(0))
    share = F.coalesce(F.when(c("width") * c("height") > 0, c("_area") / (c("width") * c("height"))), F.lit(0.0))
    heavy = F.when((denied > most_boxes) | (share > most_area), "text_heavy")
    by_mode = {
        "textless": F.when(has, "has_title").when(significant > 0, "text_heavy"),
        "custom": F.coalesce(heavy, F.when(has, "has_title") if "title" not in allow else F.when(~has, "no_title") if require_title else F.lit(None)),
        "title_only": F.coalesce(heavy, F.when(~has, "no_title") if require_title else F.lit(None)),
    }
    none = F.lit(None) if mode == "textless" or (mode == "custom" and not require_title) else F.lit("no_text")
    reason = F.when(c("_format").isNull(), none).when(c("_format"), "format_blocklist").otherwise(by_mode[mode])
    out = j.withColumn("reason", reason.cast("string"))
    return out.select("image", c("reason").isNull().alias("accepted"), "reason", has.alias("has_title"), significant.cast("long").alias("significant"), denied.cast("long").alias("denied"), share.alias("denied_area"))


def replay(labels: DataFrame, regions: DataFrame) -> DataFrame:
    """image, changed, denied, denied_area, accepted: what stored decisions would be under the season rule of today.

    labels(image, width, height, mode, allow array<string>, most_boxes, most_area), regions(image, box_id, text, category,
    significant, left, top, right, bottom): a region whose text names a season becomes one, others keep their category.
    """
    named = normalise(c("text")).rlike(f"^(?:{'|'.join(SEASONS)})$")
    r = regions.withColumn("_now", F.when(named, "season").otherwise(c("category"))).join(labels.select("image", "width", "height", "allow"), "image")
    denied = c("significant") & ~F.array_contains("allow", c("_now"))
    area = (c("right") - c("left")) * (c("bottom") - c("top")) / (c("width") * c("height"))
    s = r.groupBy("image").agg(F.count_if(c("_now") != c("category")).alias("changed"), F.count_if(denied).alias("denied"), F.sum(F.when(denied, area).otherwise(0.0)).alias("denied_area"))
    j = labels.join(s, "image", "left").na.fill(0, ["changed", "denied"]).na.fill(0.0, ["denied_area"])
    return j.select("image", "changed", "denied", "denied_area", ((c("mode") == "custom") & (c("denied") <= c("most_boxes")) & (c("denied_area") <= c("most_area"))).alias("accepted"))
