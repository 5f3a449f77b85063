"""Fixed values of the method, in one place."""

# --- fixed values: booster defaults -------------------------------------------------
DEFAULT_BOOSTER_PARAMS = {"silent": 1, "nthread": 1, "eta": 0.01, "max_depth": 1}

# --- fixed values: run defaults -----------------------------------------------------
DEFAULT_ESTIMATION_SET = 20
DEFAULT_NR_FOLDS = 5
DEFAULT_SEED = 666
DEFAULT_RANK_SEED = 777
DEFAULT_EVAL_METRIC = "rmse"
MAX_ROUNDS = 5000
ROUNDS_PER_BATCH = 50

# --- fixed values: elbow ("triangle") rule ------------------------------------------
ELBOW_PRECISION = 0.001
ELBOW_X_SCALE = 10  # scale used on loss curves
ELBOW_LABEL_X_SCALE = 3  # scale used for inclusion labels
ELBOW_STREAK = 3
ELBOW_MIN_POINTS = 4

# --- fixed values: regularized squared-loss boosting --------------------------------
BASE_SCORE = 0.5
REG_LAMBDA = 1.0
MIN_GAIN = 1e-6

# --- fixed values: file layouts -----------------------------------------------------
ANNOTATED_META_LINES = 10  # followed by exactly one blank line
DEFAULT_DELIMITER = "\t"
