"""Table schemas, enumerations and the fixed values the scoring semantics depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------

# Rule names in firing order, with their weights; a rule score is capped at SCORE_CAP.
RULE_WEIGHTS = {
    "high_amount": 30.0,
    "high_velocity": 25.0,
    "unusual_merchant": 20.0,
    "card_mismatch": 20.0,
    "unusual_hours": 10.0,
    "country_mismatch": 15.0,
}
SCORE_CAP = 100.0

# Rule limits: amount above, recent count above, hours before.
HIGH_AMOUNT_LIMIT = 5000
VELOCITY_LIMIT = 3
QUIET_HOURS_END = 6

# Velocity windows in seconds.
WINDOW_5MIN = 300
WINDOW_1H = 3600

# Weights of the score layers.
ENSEMBLE_WEIGHTS = {"rule": 0.45, "ml": 0.45, "context": 0.10}

# Amount tiers: label, lowest amount, highest amount (None = open), threshold.
THRESHOLD_TIERS = (
    ("low", 0, 1000, 70.0),
    ("medium", 1001, 10000, 60.0),
    ("high", 10001, 50000, 50.0),
    ("critical", 50001, None, 40.0),
)
DEFAULT_THRESHOLD = 70.0

# Merchant categories that count as risky.
HIGH_RISK_CATEGORIES = ("cryptocurrency", "money_transfer", "gambling", "adult", "pharmacy")
CRYPTO_CATEGORY = "cryptocurrency"

# Feature names in vector order.
FEATURE_NAMES = (
    "amount",
    "amount_vs_user_avg",
    "amount_vs_user_std",
    "tx_count_last_5min",
    "tx_count_last_1h",
    "hour_of_day",
    "is_weekend",
    "merchant_risk_level",
    "is_crypto",
    "amount_round_number",
)

# Classification -> transaction status; anything else is pending.
STATUS_OF_CLASS = {"legitimate": "approved", "review": "flagged", "fraud": "blocked"}
PENDING = "pending"

# Analyst action -> resulting alert status, and the status the action may start from.
STATUS_OF_ACTION = {"review": "reviewed", "false_positive": "resolved", "revert": "open"}
ALLOWED_FROM = {"review": "open", "false_positive": "open", "revert": "reviewed"}
ALERT_OPEN = "open"

# Drift: bins, smoothing, score factor, alarm level; retraining: lowest f1, drifted features.
PSI_BINS = 10
PSI_EPSILON = 1e-10
DRIFT_FACTOR = 10.0
DRIFT_THRESHOLD = 30.0
MIN_F1 = 0.7
MIN_DRIFTED_FEATURES = 3
RECENT_SCORES = 200
RECENT_WINDOW = 100
RECENT_RUNS = 20

# Report queue: failure prefix, retries, base of the back-off in seconds.
FAILURE_PREFIX = "Error:"
MAX_RETRIES = 3
BACKOFF_BASE = 3

# Score histogram buckets and risk bands.
HISTOGRAM_BUCKETS = ((0, 20, "0-20"), (21, 40, "21-40"), (41, 60, "41-60"), (61, 80, "61-80"), (81, 100, "81-100"))
BAND_HIGH = 70
BAND_MEDIUM = 40

# Largest page of a list.
MAX_PAGE_SIZE = 100

# Forest defaults: trees, rows per tree, seed.
FOREST_TREES = 100
FOREST_PSI = 256
FOREST_SEED = 42

# --- Schemas ----------------------------------------------------------------

MONEY = T.DecimalType(12, 2)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


TRANSACTIONS = _struct(
    transaction_id=T.StringType(),
    amount=MONEY,
    currency=T.StringType(),
    merchant_name=T.StringType(),
    merchant_category=T.StringType(),
    card_last4=T.StringType(),
    status=T.StringType(),
    user_id=T.StringType(),
    country=T.StringType(),
    ts=T.TimestampNTZType(),
    created_at=T.TimestampNTZType(),
    updated_at=T.TimestampNTZType(),
    deleted_at=T.TimestampNTZType(),
)

AUDIT_ENTRIES = _struct(
    action_type=T.StringType(),
    transaction_id=T.StringType(),
    user_id=T.StringType(),
    previous_status=T.StringType(),
    new_status=T.StringType(),
    details=T.StringType(),
    sha256_checksum=T.StringType(),
    created_at=T.TimestampNTZType(),
)

TRAINING_CSV = _struct(
    transaction_id=T.StringType(),
    user_id=T.StringType(),
    amount=T.DoubleType(),
    currency=T.StringType(),
    merchant_name=T.StringType(),
    merchant_category=T.StringType(),
    timestamp=T.StringType(),
    is_fraud=T.IntegerType(),
    hour_of_day=T.IntegerType(),
    is_weekend=T.IntegerType(),
    is_crypto=T.IntegerType(),
    amount_round_number=T.IntegerType(),
    user_avg_amount=T.DoubleType(),
    user_std_amount=T.DoubleType(),
)

REPORT_REQUEST = _struct(
    transaction_id=T.StringType(),
    score_breakdown=_struct(
        rule_score=T.DoubleType(),
        ml_score=T.DoubleType(),
        ensemble_score=T.DoubleType(),
        fired_rules=T.ArrayType(T.StringType()),
        threshold=T.DoubleType(),
    ),
    transaction=_struct(
        id=T.StringType(),
        amount=T.DoubleType(),
        currency=T.StringType(),
        merchant_name=T.StringType(),
    ),
    retry_count=T.IntegerType(),
)

FOREST_NODES = _struct(
    tree=T.IntegerType(),
    node=T.IntegerType(),
    feature=T.IntegerType(),
    split=T.DoubleType(),
    depth=T.IntegerType(),
    size=T.IntegerType(),
)

FOREST_PARAMS = _struct(
    n_trees=T.IntegerType(),
    psi=T.IntegerType(),
    seed=T.LongType(),
    contamination=T.DoubleType(),
    offset=T.DoubleType(),
)
