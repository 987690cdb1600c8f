"""Fixed schemas, enums and thresholds of the pipeline state.

The values under "fixed values" must equal the behaviour being matched
(ledger tables, enum spellings, thresholds, validation messages); they are
stated here once and imported everywhere else.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# fixed values: enums
# --------------------------------------------------------------------------
JOB_STATUSES = ("pending", "running", "completed", "failed")
TEMPLATE_TYPES = ("directory", "calculator")
MONETIZATION_VECTORS = ("LEAD_GEN", "HIGH_TICKET_AFFILIATE", "PER_CLICK")
MONETIZATION_PATTERNS = ("local_lead_generation", "contextual_affiliation", "premium_cpc")
VERDICTS = ("approved", "rejected")
API_JOB_STATUSES = ("queued", "running", "succeeded", "failed")
REJECTION_REASONS = (
    "schema_invalid",
    "keyword_difficulty_too_high",
    "uniqueness_below_threshold",
)

# --------------------------------------------------------------------------
# fixed values: thresholds and caps (all overridable per call)
# --------------------------------------------------------------------------
MAX_DIFFICULTY = 35
MIN_UNIQUENESS = 0.60
MIN_CONFIDENCE = 0.5
MIN_IMPRESSIONS = 300
MAX_CTR = 0.02
MAX_FLAGGED_PAGES = 10
MAX_ROUTES = 500
MAX_DIMENSIONS = 2
PROFILE_SAMPLE = 100
CALCULATOR_INPUTS = 5
FEW_SOURCES = 3
FEW_SOURCES_PENALTY = 2.5
LEAD_GEN_BASE = 3.5
HIGH_TICKET_MULTIPLIER = 2.0
PROJECT_SLUG_MAX = 58
SCORING_FIELDS = (
    "estimated_monthly_volume",
    "average_cpc",
    "keyword_difficulty",
    "estimated_lead_value",
    "uniqueness_potential_ratio",
)
TABULAR_FORMATS = ("csv", "tsv", "json", "parquet", "xls", "xlsx")
KEYWORD_ROW_KEYS = ("keywords", "metrics", "results", "data")
SUPPORTED_SUFFIXES = (".csv", ".tsv", ".json", ".ndjson", ".parquet", ".pq")
PAGES_DEV_PATTERN = r"https://[a-z0-9.\-]+\.pages\.dev"
JSONRPC_VERSION = "2.0"

# --------------------------------------------------------------------------
# fixed values: validation messages (field: message; ...)
# --------------------------------------------------------------------------
MSG_REQUIRED = "Field required"
MSG_STRING = "Input should be a valid string"
MSG_INT = "Input should be a valid integer"
MSG_INT_FRACTION = "Input should be a valid integer, got a number with a fractional part"
MSG_NUMBER = "Input should be a valid number"
MSG_LIST = "Input should be a valid list"
MSG_GE = "Input should be greater than or equal to {}"
MSG_LE = "Input should be less than or equal to {}"
MSG_ENUM = "Input should be 'LEAD_GEN', 'HIGH_TICKET_AFFILIATE' or 'PER_CLICK'"

# --------------------------------------------------------------------------
# ledger tables
# --------------------------------------------------------------------------
S, L, I, D, B, TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)
STRINGS = T.ArrayType(T.StringType())


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


LEDGER = {
    "scout_jobs": _schema(
        ("id", L), ("seed_niche", S), ("source_portal", S), ("source_url", S),
        ("status", S), ("log_trace", S), ("dataset_profile_id", L),
        ("created_at", TS), ("updated_at", TS),
    ),
    "dataset_profiles": _schema(
        ("id", L), ("source_dataset", S), ("source_path", S), ("row_count", L),
        ("column_count", L), ("schema_profile", S), ("duckdb_view", S),
        ("created_at", TS), ("updated_at", TS),
    ),
    "site_generations": _schema(
        ("id", L), ("dataset_profile_id", L), ("evaluation_id", L),
        ("template_type", S), ("status", S), ("build_path", S), ("log_trace", S),
        ("created_at", TS), ("updated_at", TS),
    ),
    "deployments": _schema(
        ("id", L), ("site_generation_id", L), ("project_slug", S),
        ("cloudflare_project_id", S), ("cloudflare_deployment_id", S), ("live_url", S),
        ("status", S), ("log_trace", S), ("created_at", TS), ("updated_at", TS),
    ),
    "arbitrage_opportunities": _schema(
        ("id", L), ("scout_job_id", L), ("niche_id", S), ("target_dataset_url", S),
        ("primary_keywords", STRINGS), ("estimated_monthly_volume", L),
        ("average_cpc", D), ("keyword_difficulty", I),
        ("data_sources_available", STRINGS), ("monetization_vector", S),
        ("estimated_lead_value", D), ("uniqueness_potential_ratio", D),
        ("arbitrage_score", D), ("source", S), ("status", S),
        ("created_at", TS), ("updated_at", TS),
    ),
    "evaluations": _schema(
        ("id", L), ("opportunity_id", L), ("monetization_pattern", S),
        ("template_type", S), ("seo_route_pattern", S),
        ("seo_high_volume_columns", STRINGS), ("seo_sample_routes", STRINGS),
        ("confidence", D), ("verdict", S), ("rationale", S),
        ("created_at", TS), ("updated_at", TS),
    ),
    "analytics_logs": _schema(
        ("id", L), ("deployment_id", L), ("page_path", S), ("impressions", L),
        ("clicks", L), ("revenue_cents", L), ("captured_at", TS),
    ),
    "optimizations": _schema(
        ("id", L), ("deployment_id", L), ("page_path", S), ("impressions", L),
        ("clicks", L), ("ctr", D), ("action", S), ("detail", S),
        ("redeployed", B), ("status", S), ("created_at", TS),
    ),
    "jobs": _schema(
        ("id", S), ("kind", S), ("status", S), ("params", S), ("result", S),
        ("error", S), ("created_at", TS), ("started_at", TS), ("finished_at", TS),
    ),
}

# Candidate as a typed struct (after validation).
CANDIDATE_FIELDS = (
    ("niche_id", S),
    ("target_dataset_url", S),
    ("primary_keywords", STRINGS),
    ("estimated_monthly_volume", L),
    ("average_cpc", D),
    ("keyword_difficulty", I),
    ("data_sources_available", STRINGS),
    ("monetization_vector", S),
    ("estimated_lead_value", D),
    ("uniqueness_potential_ratio", D),
    ("source", S),
)

PAGE_METRIC = _schema(
    ("page_path", S), ("impressions", L), ("clicks", L), ("revenue_cents", L)
)
