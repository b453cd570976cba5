"""Fixed values shared by the jobs. They must equal the values of the service being analysed."""

# Topics.
RAW_TOPIC = "metrics.raw"
DEAD_LETTER_TOPIC = "metrics.dlq"

# Sliding aggregation.
WINDOW_SIZE = "5 minutes"
WINDOW_SLIDE = "1 minute"
WATERMARK = "10 minutes"

# Admission.
MAX_BODY_BYTES = 10_240
CLOCK_DRIFT_MS = 300_000
LOCK_SECONDS = 10
RESPONSE_TTL_SECONDS = 86_400
RATE_WINDOW_SECONDS = 60
RATE_LIMIT = 100

# Request metrics.
DURATION_BOUNDS_SECONDS = (0.01, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0)
UNMEASURED_ROUTES = ("/metrics", "/health")

# Live view.
CARD_TYPES = ("temperature", "cpu_usage")
CHART_POINTS = 25

# Validation messages.
DEVICE_ID_MESSAGE = "deviceId must be a valid UUID v4"
DRIFT_MESSAGE = "Timestamp must be within 5 minutes of server time (clock drift check)"
