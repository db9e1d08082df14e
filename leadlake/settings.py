"""Fixed values every operator shares.

All of them are parameters of the scoring and monitoring rules; the operators take
them as defaults and accept other values as keyword arguments.
"""

# Scoring.
DECISION_THRESHOLD = 0.5
BAND_FLOORS = ((0.75, "hot"), (0.5, "warm"), (0.25, "cool"))
LOWEST_BAND = "cold"
DEFAULT_BASE_RATE = 0.38
HALF_LIFE_DAYS = 21.0
DEFAULT_DEAL_VALUE = 1000.0
DEFAULT_DAILY_CAPACITY = 50
# Heuristic scorer: (field, value at which the signal saturates, weight).
HEURISTIC_TERMS = (
    ("time_on_site_seconds", 300.0, 0.5),
    ("page_views_per_visit", 5.0, 0.25),
    ("total_visits", 10.0, 0.25),
)

# Cold-start tiers, lowest label count first.
TIER_FLOORS = (("recalibrated", 1), ("tenant", 500), ("continuous", 5000))
LOWEST_TIER = "generic"

# Training.
MIN_TRAINING_ROWS = 200
MIN_CLASS_ROWS = 25
PROMOTION_MARGIN = 0.005
ENSEMBLE_NAME = "hybrid_ensemble"
INFREQUENT_LEVEL_ROWS = 25

# Leakage screen.
SOLO_AUC_LIMIT = 0.93
SOLO_AUC_CRITICAL = 0.98
PURITY_LIMIT = 0.95
PURITY_FLOOR = 0.05
MIN_SUPPORT = 25
MIN_COVERAGE = 0.02
HIGH_COVERAGE = 0.08
CRITICAL_COVERAGE = 0.25
NUMERIC_SHARE = 0.9
SEVERITIES = ("critical", "high", "moderate")
SUSPICIOUS_NAME_TOKENS = (
    "tag", "status", "stage", "quality", "grade", "disposition", "outcome",
    "result", "closed", "won", "lost", "rating", "score", "profile",
)

# Monitoring.
PSI_WARN = 0.1
PSI_ALERT = 0.25
PSI_EPSILON = 1e-6
MIN_DRIFT_ROWS = 50
DISCRETE_VALUE_LIMIT = 20
QUANTILE_BINS = 10
CATEGORY_LIMIT = 25
ECE_OK = 0.05
ECE_WARN = 0.12
HEALTH_ORDER = ("ok", "insufficient_data", "warn", "alert")
HEALTH_ADVICE = {
    "ok": "No action needed.",
    "insufficient_data": "Collect more scored leads and outcomes.",
    "warn": "Monitor; schedule a retrain if the trend continues.",
    "alert": "Retrain on recent data.",
}

# Column mapping.
AUTO_ACCEPT = 0.85
REVIEW_FLOOR = 0.45
NAME_FLOOR = 0.72
ALIAS_CONFIDENCE = (0.95, 0.72)
NAME_WEIGHT = 0.72
SHAPE_WEIGHT = 0.28
BINARY_VALUE_PAIRS = (
    ("0", "1"), ("yes", "no"), ("true", "false"), ("y", "n"),
    ("converted", "not converted"),
)

# Word lists for coercion.
TRUTHY = ("1", "true", "yes", "won", "converted", "y")
FALSY = ("0", "false", "no", "lost", "n")
OPT_OUT_WORDS = ("yes", "true", "1")
PII_FIELDS = (
    "display_name", "email", "phone", "first_name", "last_name", "full_name", "address",
)
POST_OUTCOME_COLUMNS = (
    "Tags", "Lead Quality", "Lead Profile", "Asymmetrique Activity Index",
    "Asymmetrique Profile Index", "Asymmetrique Activity Score",
    "Asymmetrique Profile Score",
)

# Next best action and the reason shown with it.
ACTION_REASONS = {
    "no_outreach": "This lead has opted out of contact.",
    "call_now/working": "High score and a working professional — call while intent is fresh.",
    "call_now/sms": "Responded to SMS and scores well; a call is likely to connect.",
    "personal_email": "Above threshold but no strong channel signal — start with email.",
    "nurture_sequence": "Engaged with the site but scores low; nurture rather than call.",
    "monitor": "Not enough signal to justify a rep's time yet.",
}

# Sentences of a score's explanation; p is a percentage.
SUMMARY_HEURISTIC = ("No trained artifacts are loaded, so this ", "% score comes from the engagement heuristic.")
SUMMARY_OPENING = "This lead scores "
SUMMARY_ABOVE = "% and is prioritised for follow-up."
SUMMARY_BELOW = "%, below the 50% follow-up threshold."
SUMMARY_FACTORS = " Biggest factors versus a typical lead: "
SUMMARY_NO_FACTOR = " Its attributes sit close to the typical lead, so no single field stands out."
