"""Column functions of the ranking: shrinkage, gates, normalised features, weighted and residual scores.

A null feature means "not computed": it takes no part and its weight goes to the others.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(x.cast("double"), F.lit(1.0)))


def provenance(vote_average: Column, vote_count: Column) -> Column:
    """Votes shrunk towards the prior mean, as a share of ten."""
    n = F.greatest(vote_count, F.lit(0)).cast("double")
    return clip((n * vote_average + fixed.PRIOR_COUNT * fixed.PRIOR_MEAN) / (n + fixed.PRIOR_COUNT) / 10)


def text_residual(boxes: Column, area: Column) -> Column:
    return F.least(fixed.RESIDUAL_COUNT_WEIGHT * F.least(boxes / fixed.RESIDUAL_COUNT_SAT, F.lit(1.0)) + fixed.RESIDUAL_AREA_WEIGHT * area, F.lit(1.0))


def language_match(language: Column, preferred: str = "en") -> Column:
    return F.when(language.isNull(), 0.5).when(language == preferred, 1.0).otherwise(0.2)


def artifact_badness(blockiness: Column, noise: Column) -> Column:
    return (clip(blockiness / fixed.BLOCKINESS_SAT) + clip(noise / fixed.NOISE_SAT)) / 2


def ramp(x: Column, low: float, high: float) -> Column:
    return clip((x - low) / (high - low)) if high > low else F.when(x.isNotNull(), 0.0)


def normalised(c: Mapping[str, Column], dino_range: tuple[float, float] = fixed.KNN_RANGE) -> dict[str, Column]:
    """Every feature of `c` in [0, 1] with 1 as best; nulls stay null."""
    out = {
        "knn_sim": lambda x: ramp(x, *fixed.KNN_RANGE),
        "aesthetic": lambda x: clip(x / fixed.AESTHETIC_MAX),
        "title_colorfulness": lambda x: F.when(F.coalesce(c["title_found"], F.lit(False)), clip(x / fixed.TITLE_COLORFULNESS_MAX)).otherwise(fixed.TITLE_COLORFULNESS_NEUTRAL),
        "text_residual": lambda x: clip(1 - x),
        "resolution": lambda x: clip(x / fixed.RESOLUTION_MAX_MP),
        "sharpness": lambda x: clip(F.log1p(F.greatest(x, F.lit(0.0))) / F.log1p(F.lit(fixed.SHARPNESS_MAX))),
        "face_area": lambda x: clip(1 - x),
        "provenance": clip,
        "lang_match": clip,
        "dino_knn": lambda x: ramp(x, *dino_range),
        "taste_typicality": clip,
        "quality_artifacts": lambda x: clip(1 - x),
        "official_family": lambda x: ramp(x, *fixed.OFFICIAL_RANGE),
    }
    return {k: F.when(c[k].isNotNull(), f(c[k])) for k, f in out.items() if k in c}


def weighted_score(features: Mapping[str, Column], weights: Mapping[str, float] = fixed.WEIGHTS) -> Column:
    """Mean of the present features by weight; null where no weighted feature is present. Negative weights are refused."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    used = [(features[k], w) for k, w in weights.items() if w > 0 and k in features]
    if not used:
        raise ValueError("no feature with a positive weight")
    total = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for x, w in used), F.lit(0.0))
    gained = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in used), F.lit(0.0))
    return F.when(total > 0, clip(gained / total))


def logit(p: Column, epsilon: float = 1e-6) -> Column:
    q = F.greatest(F.lit(epsilon), F.least(p, F.lit(1 - epsilon)))
    return F.log(q / (1 - q))


def residual_score(baseline: Column, features: Mapping[str, Column], weights: Mapping[str, float], bias: float = 0.0, alpha: float = 0.5, most: float = 0.75) -> Column:
    """The baseline moved on the logit scale by at most alpha * most; null where a needed feature is null."""
    if not 0 <= alpha <= 1 or not 0 < most <= 2:
        raise ValueError("alpha must lie in [0, 1] and most in (0, 2]")
    raw = sum((features[k] * w for k, w in weights.items()), F.lit(float(bias)))
    moved = logit(baseline) + alpha * F.greatest(F.lit(-most), F.least(raw, F.lit(most)))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(moved, F.lit(30.0)))))


def metadata_reason(width: Column) -> Column:
    return F.when(width < fixed.MIN_WIDTH, "resolution_floor")


def style_reason(aesthetic: Column, knn: Column, personalised: bool = True) -> Column:
    rescued = (knn >= fixed.RESCUE_KNN) & (aesthetic >= fixed.RESCUED_MIN_AESTHETIC) if personalised else F.lit(False)
    out = F.when((aesthetic < fixed.MIN_AESTHETIC) & ~rescued, "aesthetic_floor")
    return out.when(knn < fixed.MIN_KNN, "off_style_floor") if personalised else out


def junk_reason(aesthetic: Column, provenance_: Column, resolution: Column, enabled: bool = True) -> Column:
    if not enabled:
        return F.lit(None).cast("string")
    return F.when((aesthetic < fixed.JUNK_AESTHETIC) & (provenance_ < fixed.JUNK_PROVENANCE) & (resolution < fixed.JUNK_RESOLUTION_MP), "fan_junk_combo")


def resolution_label(width: Column) -> Column:
    return F.when(width >= 3800, "2160p").when(width >= 1900, "1080p").when(width >= 1200, "720p").when(width.isNotNull(), "SD")


def uptime(seconds: Column) -> Column:
    s = seconds.cast("long")
    days, hours, minutes = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    return F.when(days > 0, F.format_string("%dd %dh %dm", days, hours, minutes)).when(hours > 0, F.format_string("%dh %dm", hours, minutes)).otherwise(F.format_string("%dm", minutes))


def position_label(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, up to three letters."""
    letter = lambda k: F.char((k + 65).cast("int"))
    one, two = n - 1, n - 27
    three = n - 703
    return (
        F.when(n <= 26, letter(one))
        .when(n <= 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )
