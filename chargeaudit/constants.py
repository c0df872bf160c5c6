"""Values every part of the package agrees on."""

from __future__ import annotations

# They decide the results and are kept exactly as published.
CONVERSION_FACTOR = 32.74
MIN_BILL_CHARS = 50
MAX_CODES_PER_BILL = 100
DEFAULT_TOP_K = 5
MAX_TOP_K = 20
MAX_TOOL_TOP_K = 10
MAX_UPLOAD_MB = 10
REQUESTS_PER_MINUTE = 10
TABLE_DESCRIPTION_CHARS = 50
PREAMBLE_SCAN_LINES = 15
PREAMBLE_FALLBACK_LINE = 9

# For every column we need, the whole names that win first and then the parts of
# names that raw files use for it, best first.
CODE_LIST_COLUMNS = {
    "code": ((), ("hcpc", "code")),
    "long_description": ((), ("long_description", "long_desc", "description")),
    "short_description": ((), ("short_description", "short_desc")),
}
RATE_COLUMNS = {
    "code": ((), ("hcpcs_cd", "hcpcs", "code")),
    "work_rvu": (("rvu",), ("work_rvu", "wrvu", "physician_work_rvu", "work_rvus")),
    "pe_rvu": ((), ("fac_pe_rvu", "non_fac_pe_rvu", "pe_rvu")),
    "mp_rvu": (("rvu.1",), ("mp_rvu", "mal_rvu", "malpractice_rvu", "malpractice")),
}

CATALOG_CODE_SHAPE = r"^[A-Z0-9]{5}$"
TEXT_CODE_PATTERN = r"\b([A-Z]\d{4}|\d{5})\b"

ANOMALY_TYPES = (
    "price_overcharge",
    "duplicate_charge",
    "unbundling",
    "upcoding",
    "unknown_code",
)
SEVERITIES = ("high", "medium", "low", "info")
FILE_TYPES = ("pdf", "image")

TYPE_LABELS = {
    "price_overcharge": "Price Overcharge",
    "duplicate_charge": "Duplicate Charge",
    "unbundling": "Unbundling",
    "upcoding": "Upcoding",
    "unknown_code": "Unknown Code",
}
SEVERITY_LABELS = {"high": "High", "medium": "Medium", "low": "Low", "info": "Info"}
SUBJECT_LABELS = {
    "price_overcharge": "Possible Overcharge",
    "duplicate_charge": "Duplicate Charge",
    "unbundling": "Unbundling Concern",
    "upcoding": "Upcoding Concern",
    "unknown_code": "Unknown Charge Code",
}

# Billed / reference: above HIGH_RATIO is high, from MEDIUM_RATIO medium,
# from LOW_RATIO low, below that no finding.
HIGH_RATIO = 3.0
MEDIUM_RATIO = 1.5
LOW_RATIO = 1.2

# Own choices, where the written rules leave the severity open.
SAME_DAY_DUPLICATE_SEVERITY = "high"
ADJACENT_DUPLICATE_SEVERITY = "medium"
UNBUNDLING_SEVERITY = "medium"
UPCODING_SEVERITY = "medium"
UNKNOWN_CODE_SEVERITY = "medium"
UNCODED_LINE_SEVERITY = "info"
SUMMARY_BILL_SEVERITY = "info"

# Own choices that bound the work of one task; none of them changes a result.
FINDINGS_PER_PART = 500      # letters and documents of larger bills come in parts
PAGES_PER_PART = 500         # texts of larger documents come in parts
HOT_KEY_ROWS = 1_000_000     # keys above this are numbered in ranges
VECTOR_BLOCK_ROWS = 8_192    # catalog vectors compared by one task at a time
