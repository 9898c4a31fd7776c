"""Results of a run: why candidates were turned away, what is shown of them, funnels, display ranks, scorers and knobs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import position_label
from ..functions.texts import reason_base

c = F.col

# Stages in the order they are shown, the stage of each reason, labels and sentences.
STAGES = ("sha256", "resolution", "style", "ocr", "phash", "fan_junk", "errored")
REASON_STAGE = {
    "dedup_sha256": "sha256", "resolution_floor": "resolution", "aesthetic_floor": "style", "off_style_floor": "style", "text_heavy": "ocr", "ocr_text_heavy": "ocr", "no_title": "ocr", "no_text": "ocr",
    "format_blocklist": "ocr", "dedup_phash": "phash", "fan_junk_combo": "fan_junk", "feature_error": "errored", "download_error": "errored", "ocr_error": "errored",
}
REASON_LABEL = {
    "text_heavy": "Text heavy", "ocr_text_heavy": "Text heavy", "no_text": "No text found", "ocr_no_text": "No text found", "no_title": "Title not matched", "ocr_no_title": "Title not matched",
    "format_blocklist": "Format badge", "has_title": "Title detected", "ocr_error": "OCR error", "ocr_rejected": "OCR rejected",
}
REASON_SENTENCE = {
    "resolution_floor": "Image resolution is below the minimum width.", "style_aesthetic_floor": "Production quality is below the acceptable floor.", "off_style_floor": "Visual style is too far from your taste profile.",
    "ocr_text_heavy": "Too much non-title text was detected.", "text_heavy": "Too much non-title text was detected.", "ocr_no_text": "No text found.", "ocr_no_title": "Title not matched in detected text.",
    "no_text": "No text found.", "no_title": "Title not matched in detected text.", "format_blocklist": "Format badge detected.", "has_title": "Title text is excluded by the active profile.",
    "ocr_error": "OCR could not process this poster.", "ocr_rejected": "OCR rejected this poster.", "dedup_sha256": "Byte-for-byte duplicate of another candidate.",
    "dedup_phash": "Visually near-identical to another candidate.", "fan_junk": "Flagged as low-quality fan art by the combined junk gate.",
}
FUNNEL = ("total_candidates", "sha256_survivors", "ocr_survivors", "phash_survivors", "feature_survivors", "ranked")


def literal(m: Mapping[str, str], key: Column) -> Column:
    """The value of a small fixed table, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), key)


def rejection_stage(reason: Column, reached: Column) -> Column:
    """The stage a candidate was turned away at: by its reason, else by how the reason begins, else by how far it came."""
    base = F.coalesce(reason_base(reason), F.lit(""))
    return F.coalesce(
        literal(REASON_STAGE, base),
        F.when(base.startswith("dedup_"), F.when(base.contains("phash"), "phash").otherwise("sha256")).when(base.startswith("ocr"), "ocr")
        .when(base.startswith("feature_error") | base.startswith("download_error"), "errored").when(reached == "ocr", "ocr").otherwise("style"),
    )


def rejection_group(reason: Column, reached: Column) -> Column:
    """The coarser group: dedup, errored, ocr or gate."""
    base = F.coalesce(reason_base(reason), F.lit(""))
    return (
        F.when(base.startswith("dedup_"), "dedup").when(base.startswith("feature_error") | base.startswith("download_error"), "errored")
        .when(base.startswith("ocr") | base.isin("no_text", "no_title") | F.coalesce(reached == "ocr", F.lit(False)), "ocr").otherwise("gate")
    )


def rejection_sentence(reason: Column) -> Column:
    base = reason_base(reason)
    plain = F.regexp_replace(F.lower(reason), "_", " ")
    said = F.concat(F.upper(F.substring(plain, 1, 1)), plain.substr(F.lit(2), F.length(plain)), F.lit("."))
    return (
        F.when(F.coalesce(reason, F.lit("")) == "", "Rejected.")
        .otherwise(F.coalesce(literal(REASON_SENTENCE, base), F.when(base.startswith("feature_error") | base.startswith("download_error"), "Could not be processed (image or download error)."), said))
    )


def result_view(candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ranked list, the stacks and the counts by stage of each run.

    candidates(run, candidate_id, rank, stack_rank, stack_pos, stack_score, reason, reached); a run has a bounded number.
    """
    ranked = candidates.where(c("rank").isNotNull()).select("run", "candidate_id", "rank")
    member = F.struct(F.coalesce("stack_pos", F.lit(0)).alias("p"), "candidate_id")
    stacks = candidates.where(c("rank").isNotNull() & c("stack_rank").isNotNull()).groupBy("run", "stack_rank").agg(F.max("stack_score").alias("stack_score"), F.transform(F.sort_array(F.collect_list(member)), lambda x: x["candidate_id"]).alias("members"))
    stacks = stacks.select("run", "stack_rank", "stack_score", F.size("members").cast("long").alias("size"), c("members")[0].alias("representative"), "members")
    gone = candidates.where(c("rank").isNull()).groupBy("run", rejection_stage(c("reason"), c("reached")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    every = candidates.select("run").distinct().withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("stage")) for i, s in enumerate(STAGES)]))).select("run", "s.place", "s.stage")
    return ranked, stacks, every.join(gone, ["run", "stage"], "left").select("run", "place", "stage", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def funnel(windows: DataFrame, by: str) -> DataFrame:
    """by, place, stage, count, dropped: what is left after each stage, over all windows of `by` that had runs.

    windows(by, window_runs, counts map<string, bigint>). A stage that a window with runs does not report is left out, and
    so is one that drops nothing, but for the first, the last and the text gate. No runs or no candidates: no rows.
    """
    w = windows.where("window_runs > 0")
    stage = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("stage")) for i, s in enumerate(FUNNEL)]))
    sums = w.select(by, "counts", stage.alias("s")).groupBy(by, "s.place", "s.stage").agg(F.count_if(F.try_element_at("counts", c("s.stage")).isNull()).alias("none"), F.sum(F.try_element_at("counts", c("s.stage"))).alias("count"))
    sums = sums.where((c("none") == 0) & ((c("stage") != FUNNEL[0]) | (c("count") > 0))).drop("none")
    order = Window.partitionBy(by).orderBy("place")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(by)
    s = sums.withColumns({"head": F.first("count").over(upto), "prior": F.lag("count").over(order), "ends": (c("place") == F.min("place").over(every)) | (c("place") == F.max("place").over(every))}).where("head > 0")
    s = s.withColumn("dropped", F.greatest(F.coalesce(c("prior"), c("count")) - c("count"), F.lit(0)))
    return s.where((c("dropped") > 0) | c("ends") | (c("stage") == "ocr_survivors")).select(by, "place", "stage", "count", "dropped")


def display_ranks(ranked: DataFrame, expanded: DataFrame) -> DataFrame:
    """subject, candidate_id, shown_rank, suffix of the cards a flat list shows.

    ranked(subject, candidate_id, rank, stack_id, stack_pos), expanded(subject, stack_id). A stack takes one rank, where its
    best member stands; only that member shows, without suffix, unless it is expanded: then all do, with A, B, C. A
    candidate without a stack is a card of its own.
    """
    card = F.coalesce(c("stack_id"), -1 - c("rank"))
    r = ranked.withColumn("_card", card)
    r = r.withColumn("_first", F.min("rank").over(Window.partitionBy("subject", "_card")))
    r = r.join(expanded.distinct().withColumn("_open", F.lit(True)), ["subject", "stack_id"], "left").withColumn("_open", F.coalesce("_open", F.lit(False)))
    r = r.withColumn("shown_rank", F.dense_rank().over(Window.partitionBy("subject").orderBy("_first")).cast("long"))
    nth = F.row_number().over(Window.partitionBy("subject", "_card").orderBy("stack_pos", "rank"))
    r = r.withColumn("_nth", nth).where(c("_open") | (c("_nth") == 1))
    return r.select("subject", "candidate_id", "shown_rank", F.when(c("_open"), position_label(F.coalesce("stack_pos", "_nth"))).alias("suffix"))


def chosen_scorer(mode: Column, stored: Column, wanted: Column) -> Column:
    """`weighted`, `residual` or `none` (a residual is asked for, but none that fits is stored): `auto` takes a residual
    whose stored form is the wanted one, else the weights."""
    fits = F.coalesce(stored == wanted, F.lit(False))
    return F.when(mode == "weighted", "weighted").when(fits, "residual").when(mode == "residual", "none").otherwise("weighted")


def resolved(profile: Mapping[str, Column], settings: Mapping[str, object]) -> dict[str, Column]:
    """Each knob from the profile where it has one, else from the settings; an empty mode counts as none."""
    own = {k: F.nullif(v, F.lit("")) if k == "mode" else v for k, v in profile.items()}
    return {k: F.coalesce(own[k], F.lit(v)) if k in own else F.lit(v) for k, v in settings.items()}


def isolated(value: Column, errors: Mapping[str, Column]) -> Column:
    """struct<value, error> of each row: the first of the named errors whose condition holds, else the measure's value. One
    row's failure is its own; a measure that is null for no named reason tells `no_value`."""
    why = F.coalesce(*[F.when(test, name) for name, test in errors.items()], F.when(value.isNull(), "no_value"))
    return F.struct(F.when(why.isNull(), value).alias("value"), why.alias("error"))
