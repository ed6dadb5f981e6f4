"""Names shared by every table."""

ACCOUNT = "account_id"

WEEK_MINUTES = 10_080
RESET_JITTER_SECONDS = 300
ORIGINAL_MAX_DELTA_MS = 2_000
LONG_GAP_MS = 36 * 60 * 60 * 1_000
MAX_WINDOW_DAYS = 3_650
