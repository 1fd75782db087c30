"""Fixed values that must equal the original tool's for the same results.

FIXED VALUES (kept verbatim, natural order):
"""

# --- label validation -------------------------------------------------------
REQUIRED_LABEL_FIELDS = (
    "document_category",
    "document_subcategory",
    "language_primary",
    "text_clarity",
    "image_quality",
    "ocr_difficulty",
)
IMPORTANT_LABEL_FIELDS = ("sensitive_data_types", "testing_scenarios", "challenge_factors")
HISTOGRAM_FIELDS = ("document_category", "ocr_difficulty", "language_primary")
GRADE_OK, GRADE_WARN, GRADE_BAD = "✅", "⚠️", "❌"
GRADE_OK_PCT, GRADE_WARN_PCT = 90.0, 70.0
MISSING_BUCKET, NULL_BUCKET = "Unknown", "None"

# --- extraction validation --------------------------------------------------
REQUIRED_EXTRACTION_FIELDS = (
    "document_type",
    "language",
    "currency",
    "total_amount",
    "vendor_name",
    "invoice_number",
    "invoice_date",
)
OPTIONAL_EXTRACTION_FIELDS = (
    "tax_amount",
    "customer_name",
    "items",
    "tax_details",
    "addresses",
    "payment_terms",
    "confidence_score",
)
KEY_INFO_FIELDS = ("document_type", "language", "currency", "total_amount", "confidence_score")

# --- model reply outcomes ---------------------------------------------------
ERR_JSON = "JSON解析失败"
ERR_STATUS_PREFIX = "API请求失败: "
ERR_TIMEOUT = "API request timed out"
ERR_NETWORK_PREFIX = "Network error: "
ERR_OTHER_PREFIX = "请求异常: "
ERR_PROCESSING_PREFIX = "Processing failed: "
ERR_PROCESSING_EXTRACTION_PREFIX = "处理异常: "
METADATA_PURPOSE = "OCR_DLP_performance_testing"
DATA_URL_PREFIX = "data:image/jpeg;base64,"

# --- summary report ---------------------------------------------------------
REPORT_HEADING = "# Image Classification Summary Report"
REPORT_RULE = "=" * 50
REPORT_OVERVIEW = "## Overview"
REPORT_TOTAL, REPORT_SUCCESSFUL = "- Total Images: ", "- Successfully Classified: "
REPORT_FAILED, REPORT_RATE = "- Failed: ", "- Success Rate: "
REPORT_TITLES = {
    "document_category": "## Document Categories",
    "ocr_difficulty": "## OCR Difficulty Distribution",
    "language_primary": "## Language Distribution",
}

# --- comparison document ----------------------------------------------------
COMPARISON_SUMMARY = {
    "extraction_purpose": "Extract specific data values from documents",
    "labeling_purpose": "Classify documents for OCR_DLP testing",
    "extraction_use_case": "Business process automation, data entry",
    "labeling_use_case": "ML system evaluation, dataset preparation",
    "extraction_focus": "Document content and data",
    "labeling_focus": "Document type and characteristics",
}

# --- image filter defaults --------------------------------------------------
MIN_SIDE, MAX_SIDE = 300, 4096
MIN_FILE_BYTES, MAX_FILE_BYTES = 5000, 10 * 1024 * 1024
ALLOWED_FORMATS = ("JPEG", "PNG", "WEBP")
MAX_ASPECT = 10
MAX_PAYLOAD_BYTES = 4 * 1024 * 1024
TRANSPARENT_MODES = ("RGBA", "LA")

# --- file naming and scans --------------------------------------------------
LABEL_SCAN_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff")
EXTRACTION_SCAN_GLOBS = ("*.jpg", "*.jpeg", "*.png", "*.webp")
DOWNLOAD_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
DEFAULT_SUFFIX = ".jpg"
FILE_NAME_FORMAT = "image_%06d"

# --- search and crawl -------------------------------------------------------
ENGINES = ("serper", "unsplash", "serpapi", "flickr")  # order used by the mixed crawl
ENGINE_PAGE_CAP = {"serper": 100, "serpapi": 100, "unsplash": 30, "flickr": 100}
FLICKR_URL_FORMAT = "https://farm%s.staticflickr.com/%s/%s_%s_b.jpg"
GIVE_UP_STATUSES = (404, 403, 410)
RETRY_ATTEMPTS = 3

# --- near-duplicates --------------------------------------------------------
HASH_BITS = 64
DEFAULT_THRESHOLD = 5

# --- failure hints ----------------------------------------------------------
RATE_LIMIT_MARKERS = ("429", "quota")
AUTH_MARKERS = ("401", "unauthorized")
