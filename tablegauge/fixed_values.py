"""Fixed values.

Names, orders, texts and numbers that logs and published tables rely on. They
are part of the data contract, not tunable settings.
"""

from __future__ import annotations

from typing import NamedTuple

# Tool names as they appear in run logs.
SCHEMA_TOOL = "querychat_get_schema"
UPDATE_TOOL = "querychat_update_dashboard"
QUERY_TOOL = "querychat_query"
RESET_TOOL = "querychat_reset_dashboard"

# Request families, in report order, and the tools each one expects.
EXPECTED_TOOLS = {
    "filter": [UPDATE_TOOL],
    "question": [QUERY_TOOL],
    "reset": [RESET_TOOL],
    "out_of_scope": [],
}
FAMILY_ORDER = list(EXPECTED_TOOLS)

# Prompt configurations in report order; those that demand a reply template.
CONFIG_ORDER = ["baseline", "datadesc", "format", "format_query"]
FORMAT_CONFIGS = ["format", "format_query"]
CONFIGS_BY_DATASET = {
    "titanic": ["baseline", "datadesc", "format", "format_query"],
    "crashes": ["baseline", "format", "format_query"],
}
# The five scores and the four provenance verdicts, in report order.
SCORES = ["tool_choice", "filter_rows", "answer_correct", "format_adherence", "number_honesty"]
VERDICTS = ["honest", "unverified", "wrong", "silent"]
TOTAL_LABEL = "**total**"  # model name of total rows

# Reply template markers, and the one dataset whose template asks for a suggestion.
TEMPLATE_MARKERS = ["🎯", "📊", "💡"]
SUGGESTION_SPAN = '<span class="suggestion">'
SUGGESTION_DATASETS = ["titanic"]

# Number patterns and tolerances of the reply checks.
NUMBER_PATTERN = r"(\d[\d,]*(?:\.\d+)?)"
ANSWER_TOLERANCE = 0.06
RATE_TOLERANCE = 0.6
RETRY_HINT_PATTERN = r"try again in ([\d.]+)(ms|s)"

# Error groups and the fragments that identify them, first match wins.
ERROR_GROUPS = [
    ("schema: `collapsed` missing", ["collapsed"]),
    ("malformed tool call",
     ["validation failed", "Failed to parse tool call", "Failed to call a function"]),
    ("rate limit (retries exhausted)", ["RateLimit"]),
]

# Models of the published matrix with their short labels, and the unlabelled provider.
MODEL_LABELS = {
    "qwen/qwen3.8-27b": "qwen3.8-27b",
    "qwen/qwen3.6-27b": "qwen3.6-27b",
    "openai/gpt-oss-20b": "gpt-oss-20b",
    "openai/gpt-oss-120b": "gpt-oss-120b",
}
MATRIX_MODELS = list(MODEL_LABELS)
DEFAULT_PROVIDER = "groq"
MODEL_KEY = "groq_model"  # the model in the header of a run log


class Price(NamedTuple):
    """Dollars per million tokens; no cached price means cached tokens are not charged."""

    model: str
    p_in: float
    p_out: float
    p_cached: float | None


class Usage(NamedTuple):
    """Typical calls and tokens of one request."""

    model: str
    calls: float
    inp: int
    out: int
    cached: int


# List prices.
PRICES = [
    Price("qwen/qwen3.8-27b", 0.80, 4.00, None),
    Price("qwen/qwen3.6-27b", 0.60, 3.00, None),
    Price("openai/gpt-oss-20b", 0.075, 0.30, 0.0375),
    Price("openai/gpt-oss-120b", 0.15, 0.60, 0.075),
    Price("claude-haiku-4-5", 1.00, 5.00, 0.10),
    Price("gpt-5.4-mini", 0.75, 4.50, 0.075),
    Price("gpt-5.4-nano", 0.20, 1.25, 0.02),
]
# Usage of one request per model.
USAGE = [
    Usage("qwen/qwen3.8-27b", 3.0, 13011, 283, 0),
    Usage("qwen/qwen3.6-27b", 2.8, 11922, 334, 0),
    Usage("openai/gpt-oss-20b", 2.2, 1440, 1422, 7232),
    Usage("openai/gpt-oss-120b", 2.2, 5044, 466, 3584),
    Usage("claude-haiku-4-5", 2.5, 1100, 300, 12000),
    Usage("gpt-5.4-mini", 3.0, 1500, 200, 7000),
    Usage("gpt-5.4-nano", 3.3, 1800, 250, 8000),
]
# Rate-limit tiers and cohort scenarios (requests per student).
FREE_TIER = {"rpm": 30, "rpd": 1000, "tpm": 8_000, "tpd": 200_000}
PAID_TIER = {"rpm": 1000, "tpm": 250_000}
SCENARIOS = [("light", 40), ("medium", 120), ("heavy", 300)]
COHORT_SIZE = 150
HISTORY_FACTOR = 1.3

# Run-length segments (value, length) of the synthetic crashes table.
CRASH_PLANETS = [("Zorgon", 30), ("Xylpha", 20), ("Brimtak", 50)]
CRASH_SURVIVED = [(1, 18), (0, 12), (1, 5), (0, 15), (1, 35), (0, 15)]
CRASH_ROLES = [("pilot", 10), ("medic", 20), ("pilot", 8), ("medic", 12), ("pilot", 25), ("medic", 25)]
CRASH_AGES = [(20, 30), (25, 20), (18, 50)]  # first age, number of consecutive ages

# The 0/1 metric column of each analysed table.
METRIC_COLUMN = {"titanic": "survived", "crashes": "survived_crash"}
