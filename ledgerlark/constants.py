"""Values that results depend on."""

# Statuses, stages and check outcomes as stored.
DOCUMENT_STATUSES = ("UPLOADED", "OCR_IN_PROGRESS", "OCR_COMPLETED", "AI_PROCESSING", "VALIDATED", "REVIEW_REQUIRED", "COMPLETED", "FAILED")
TERMINAL = ("COMPLETED", "REVIEW_REQUIRED", "FAILED")
STAGES = ("UPLOAD", "TEXT_EXTRACTION", "AI_STRUCTURING", "VALIDATION", "PERSISTENCE")
CHECK_STATUSES = ("PASSED", "FAILED", "WARNING", "SKIPPED")

# Currency codes and symbols.
CURRENCIES = (
    "USD", "EUR", "GBP", "INR", "JPY", "CNY", "AUD", "CAD", "CHF", "SEK",
    "NOK", "DKK", "NZD", "SGD", "HKD", "AED", "SAR", "ZAR", "BRL", "MXN",
    "PLN", "CZK", "HUF", "TRY", "THB", "IDR", "MYR", "PHP", "VND", "KRW",
)
CURRENCY_SYMBOLS = {"$": "USD", "US$": "USD", "€": "EUR", "£": "GBP", "₹": "INR", "¥": "JPY", "A$": "AUD", "C$": "CAD"}

# Model prices in USD for a million input and output tokens.
MODEL_PRICES = {"gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.00), "gpt-4.1-mini": (0.40, 1.60), "gpt-4.1": (2.00, 8.00)}

# Error codes and their HTTP statuses.
ERRORS = {
    "ERR_INTERNAL": 500,
    "ERR_FILE_TOO_LARGE": 413,
    "ERR_UNSUPPORTED_FORMAT": 415,
    "ERR_DUPLICATE_DOCUMENT": 409,
    "ERR_EMPTY_FILE": 422,
    "ERR_STORAGE_UNAVAILABLE": 503,
    "ERR_DATABASE_FAILURE": 503,
    "ERR_NOT_FOUND": 404,
    "ERR_OCR_FAILED": 422,
    "ERR_AI_STRUCTURING_FAILED": 422,
    "ERR_LLM_AUTH_FAILED": 503,
    "ERR_LLM_RATE_LIMITED": 429,
    "ERR_LLM_TIMEOUT": 504,
    "ERR_LLM_UNAVAILABLE": 503,
    "ERR_LLM_INVALID_RESPONSE": 422,
    "ERR_VALIDATION_FAILED": 422,
    "ERR_UNAUTHORIZED": 401,
    "ERR_FORBIDDEN": 403,
    "ERR_VALIDATION": 422,
}

# Labels, tones and symbols of the dashboard.
STATUS_LABELS = {
    "UPLOADED": ("Uploaded", "info"),
    "OCR_IN_PROGRESS": ("Extracting text", "info"),
    "OCR_COMPLETED": ("Text extracted", "info"),
    "AI_PROCESSING": ("AI structuring", "info"),
    "VALIDATED": ("Validated", "success"),
    "REVIEW_REQUIRED": ("Review required", "warning"),
    "COMPLETED": ("Completed", "success"),
    "FAILED": ("Failed", "danger"),
}
CHECK_TONES = {"PASSED": ("success", "✓"), "FAILED": ("danger", "✕"), "WARNING": ("warning", "!"), "SKIPPED": ("neutral", "—")}
ACTIVE_STEP = {
    "UPLOADED": "TEXT_EXTRACTION",
    "OCR_IN_PROGRESS": "TEXT_EXTRACTION",
    "OCR_COMPLETED": "AI_STRUCTURING",
    "AI_PROCESSING": "AI_STRUCTURING",
    "VALIDATED": "PERSISTENCE",
    "REVIEW_REQUIRED": "PERSISTENCE",
}

# Limits.
MIME_TYPES = ("application/pdf", "image/png", "image/jpeg")
MIN_BYTES, MAX_BYTES = 1024, 25 * 1024 * 1024
TEXT_BUDGET_TOKENS, CHARS_PER_TOKEN = 6000, 4
TRUNCATION_MARK = "\n\n[... document text truncated ...]"
MAX_OCR_PAGES, DIGITAL_PROBE_PAGES = 5, 3
TOLERANCE, REVIEW_THRESHOLD = "0.02", 0.85
WEIGHTS = {"ocr": 0.30, "ai": 0.40, "validation": 0.30}
EXPORT_VERSION = "1.0"
