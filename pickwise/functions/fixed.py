"""Results depend on them, so they are stated here together and not tuned."""

# Bounds of the normalised features.
KNN_RANGE = (0.4, 0.9)
AESTHETIC_MAX = 10.0
TITLE_COLORFULNESS_MAX = 60.0
TITLE_COLORFULNESS_NEUTRAL = 0.5
RESOLUTION_MAX_MP = 6.0
SHARPNESS_MAX = 2000.0
OFFICIAL_RANGE = (0.60, 0.95)

# Weights of the score.
WEIGHTS = {
    "knn_sim": 0.30,
    "aesthetic": 0.12,
    "title_colorfulness": 0.15,
    "face_area": 0.15,
    "text_residual": 0.10,
    "provenance": 0.02,
    "sharpness": 0.03,
    "resolution": 0.0,
    "lang_match": 0.0,
    "dino_knn": 0.12,
    "taste_typicality": 0.12,
    "quality_artifacts": 0.03,
    "official_family": 0.12,
}

# Saturation of the artifact measures.
BLOCKINESS_SAT = 6.0
NOISE_SAT = 12.0

# Gates.
MIN_WIDTH = 500
MIN_AESTHETIC = 4.5
MIN_KNN = 0.45
RESCUE_KNN = 0.55
RESCUED_MIN_AESTHETIC = 2.0
JUNK_AESTHETIC = 5.0
JUNK_PROVENANCE = 0.55
JUNK_RESOLUTION_MP = 1.0

# Vote shrinkage, text residual, language.
PRIOR_MEAN = 6.5
PRIOR_COUNT = 25.0
RESIDUAL_COUNT_SAT = 5
RESIDUAL_COUNT_WEIGHT = 0.5
RESIDUAL_AREA_WEIGHT = 0.5

# Near duplicates, stacks, neighbours.
PHASH_MAX_DISTANCE = 6
STACK_MIN_SIMILARITY = 0.88
STACK_TOP = 3
NEIGHBOURS = 10
TEMPERATURE = 0.1
NEGATIVE_WEIGHT = 1.0

# Calibration.
MIN_SAMPLES = 20
