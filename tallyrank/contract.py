"""Names, cut points and weights every module agrees on."""

from __future__ import annotations

# The labelled card-transaction layout, in order.
CARD_FEATURES = ["Time"] + [f"V{i}" for i in range(1, 29)] + ["Amount"]
CARD_LABEL = "Class"

# The part of that layout the driver tables can fill (view ``tx``).
TX_KEY = ["order_key", "line_no", "part_key", "supp_key", "ship_s"]
TX_FEATURES = ["time", "v1", "v2", "v3", "amount"]
TX_LABEL = "class"

# Model names a scoring request may ask for.
MODEL_NAMES = [
    "logistic_regression",
    "random_forest",
    "xgboost",
    "isolation_forest",
    "stacking_ensemble",
]
DEFAULT_MODEL = "stacking_ensemble"
BATCH_MAX = 1000

# Risk bands, lower cut of MEDIUM / HIGH / CRITICAL.
RISK_CUTS = (0.3, 0.6, 0.8)
STRICT_RISK_CUTS = (0.4, 0.7, 0.9)
RISK_ACTIONS = {
    "CRITICAL": "block",
    "HIGH": "review",
    "MEDIUM": "verify",
    "LOW": "approve",
}

# Latency rating bands in milliseconds (mean, single call).
MEAN_LATENCY_BANDS = [(20.0, "excellent"), (50.0, "good"), (100.0, "acceptable")]
CALL_LATENCY_BANDS = [(50.0, "excellent"), (100.0, "good")]
LATENCY_REST = "needs improvement"
RATE_LIMIT_PER_MINUTE = 100

SEED = 42

# Interaction weights and blend weights of the product ranking.
INTERACTION_WEIGHTS = {"view": 1.0, "click": 2.0, "purchase": 5.0}
SCORE_WEIGHTS = {
    "hybrid": 0.4,
    "text": 0.25,
    "image": 0.1,
    "interaction": 0.15,
    "field": 0.1,
}
FACTOR_WEIGHTS = {"base": 0.7, "popularity": 0.15, "recency": 0.1, "price": 0.05}
FIELD_WEIGHTS = {"name": 0.4, "category": 0.3, "brand": 0.2, "tags": 0.1}
BOOST_WEIGHTS = {"affinity": 0.5, "category": 0.3, "brand": 0.2}
DEFAULT_COLLABORATIVE = 0.5
DIVERSITY_ALPHA = 0.3
DIVERSITY_MIN_CANDIDATES = 5
HISTORY_LIMIT = 100

# Linear scorers with fixed coefficients: bias, v1, v2, v3, amount.  They give
# the metric operators several score columns that any SQL engine can repeat.
LINEAR_SCORERS = {
    "logistic_regression": (-2.0, 0.06, 5.0, -4.0, 0.00001),
    "random_forest": (1.5, -0.05, 8.0, 3.0, -0.00002),
    "xgboost": (-3.0, 0.12, -6.0, 10.0, 0.0),
    "isolation_forest": (-0.5, 0.0, 12.0, -9.0, 0.000015),
    "stacking_ensemble": (-1.0, 0.03, 2.0, 1.0, 0.000005),
}
# Weight of each base score inside the stacked score, same order of names.
META_WEIGHTS = {
    "logistic_regression": 0.8,
    "random_forest": -0.4,
    "xgboost": 1.7,
    "isolation_forest": 0.25,
}
