"""Fixed values that results depend on, in one place."""

# Canonical level names, least severe first; a level's rank is its position.
LEVELS = ("Verbose", "Debug", "Information", "Warning", "Error", "Fatal")

# Spellings of each level (compared in upper case).
LEVEL_SPELLINGS = {
    "Verbose": ("TRACE", "TRC", "VERBOSE", "VRB"),
    "Debug": ("DEBUG", "DBG", "FINE"),
    "Information": ("INFO", "INFORMATION", "INF", "NOTICE"),
    "Warning": ("WARN", "WARNING", "WRN"),
    "Error": ("ERROR", "ERR", "SEVERE", "CRIT", "CRITICAL"),
    "Fatal": ("FATAL", "FTL", "PANIC", "EMERG", "EMERGENCY", "ALERT"),
}

# Spellings that have a severity rank without being normalised first.
RANKED_SPELLINGS = {
    "VERBOSE": 0, "VRB": 0,
    "DEBUG": 1, "DBG": 1,
    "INFORMATION": 2, "INFO": 2, "INF": 2,
    "WARNING": 3, "WARN": 3, "WRN": 3,
    "ERROR": 4, "ERR": 4,
    "FATAL": 5, "FTL": 5,
}

# Words that tell a severity inside an unstructured line.
LEVEL_WORDS = (
    "TRACE", "VERBOSE", "VRB", "DEBUG", "DBG", "INFORMATION", "INFO", "INF", "NOTICE",
    "WARNING", "WARN", "WRN", "ERROR", "ERR", "FATAL", "FTL", "CRITICAL", "CRIT", "PANIC",
)

FIELD_SEPARATOR = "\x1f"

# Masks for the changing parts of a message, in the order in which they apply.
MASKS = (
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<guid>"),
    (r"\b\d{1,3}(\.\d{1,3}){3}\b", "<ip>"),
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?\b", "<datetime>"),
    (r"\b\d{1,2}:\d{2}:\d{2}(\.\d+)?\b", "<time>"),
    (r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", "<str>"),
    (r"\b0x[0-9a-fA-F]+\b", "<hex>"),
    (r"\b(?=[0-9A-Za-z]*\d)[0-9A-Za-z]{8,}\b", "<id>"),
    (r"-?(?:\b|(?<=_))\d+(\.\d+)?", "<num>"),
)

# Histogram widths in milliseconds that a reader finds natural.
NICE_WIDTHS_MS = (
    100, 250, 500, 1_000, 2_000, 5_000, 10_000, 15_000, 30_000, 60_000, 120_000, 300_000, 600_000,
    900_000, 1_800_000, 3_600_000, 7_200_000, 21_600_000, 43_200_000, 86_400_000, 604_800_000, 2_592_000_000,
)
TARGET_BINS, MAX_BINS = 120, 500
SPIKE_SIGMAS, SPIKE_WINDOW, SPIKE_HISTORY, SPIKE_MIN_TOTAL, SPIKE_MIN_ERRORS = 3.0, 30, 5, 10, 3
NOVELTY_WARMUP, NOVELTY_SEVERITY = 200, 3
BLOCK_GAP_US, BLOCK_LINES, BLOCK_SWEEP, BLOCK_QUIET_LINES = 2_000_000, 200, 1000, 5000
ALIGN_CELLS, ALIGN_LOOKAHEAD = 250_000, 25
DETECT_LINES, DETECT_SHARE, DETECT_LEAST = 30, 0.75, 2
EXCEPTION_LINES, EXCEPTION_SAMPLE_LINES, EXCEPTION_FRAMES = 1000, 40, 3
