"""Fixed values.

Names, codes, limits, texts and patterns that results depend on. They are data,
not logic: change them here to adapt the library to another regulator or scheme.
"""

# --- Columns of the applicant table -------------------------------------------
PROFILE_COLUMNS = ["LIMIT_BAL", "SEX", "EDUCATION", "MARRIAGE", "AGE"]
STATUS_COLUMNS = ["PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6"]  # latest first, there is no PAY_1
BILL_COLUMNS = [f"BILL_AMT{m}" for m in range(1, 7)]
PAID_COLUMNS = [f"PAY_AMT{m}" for m in range(1, 7)]
BASE_COLUMNS = PROFILE_COLUMNS + STATUS_COLUMNS + BILL_COLUMNS + PAID_COLUMNS
ENGINEERED_COLUMNS = [
    "utilization_ratio", "avg_pay_delay", "max_pay_delay",
    "months_late", "payment_ratio", "delay_trend",
]
WHOLE_FEATURES = ["max_pay_delay", "months_late", "delay_trend"]  # whole numbers among them
FEATURE_COLUMNS = BASE_COLUMNS + ENGINEERED_COLUMNS
KEY = "applicant_id"
TARGET = "target"
CORRELATION_COLUMNS = [
    "LIMIT_BAL", "AGE", "PAY_0", "PAY_2", "BILL_AMT1", "BILL_AMT2", "PAY_AMT1", "PAY_AMT2", TARGET,
]
MONTH_LABELS = ["M-6", "M-5", "M-4", "M-3", "M-2", "M-1 (latest)"]  # oldest first

# --- Codes ----------------------------------------------------------------------
SEX_LABELS = {1: "Male", 2: "Female"}
EDUCATION_LABELS = {1: "Graduate school", 2: "University", 3: "High school", 4: "Other"}
MARRIAGE_LABELS = {1: "Married", 2: "Single", 3: "Other"}
UNKNOWN_LABEL = "Unknown"
EDUCATION_UNDOCUMENTED, EDUCATION_OTHER = [0, 5, 6], 4
MARRIAGE_UNDOCUMENTED, MARRIAGE_OTHER = [0], 3

# --- Validation and exposure caps -------------------------------------------------
AGE_RANGE = (18, 100)
WARN_LIMIT = "LIMIT_BAL is zero or negative"
WARN_AGE = "AGE is outside plausible range (18-100)"
WARN_EDUCATION = "EDUCATION code not in expected set (1-4)"
WARN_MARRIAGE = "MARRIAGE code not in expected set (1-3)"
CLEAN_CAP = 2_000_000
AGGREGATE_CAP = 5_000_000
FLAG_CLEAN = "exceeds_r8_personal_clean_cap"
FLAG_AGGREGATE = "exceeds_r8_aggregate_cap"
CAP_LABELS = ["Applicant's limit", "SBP clean cap (R-8)", "SBP aggregate cap (R-8)"]

# --- Model ---------------------------------------------------------------------
APPROVE, REJECT = "APPROVE", "REJECT"
SEED = 42
TEST_SHARE = 0.2
FOLDS = 5
TRIALS = 75
DEFAULT_THRESHOLD = 0.55
FALLBACK_THRESHOLD = 0.5
SWEEP_PERCENT = (20, 80)  # both ends are tried
TABLE_THRESHOLDS = [0.40, 0.45, 0.50, 0.55, 0.59, 0.65]
CURRENT_TOLERANCE = 0.01
SEARCH_TREES = (100, 800)
SEARCH_DEPTH = (3, 10)
SEARCH_RATE = (0.01, 0.3)  # log scale
SEARCH_SUBSAMPLE = (0.6, 1.0)
SEARCH_COLUMN_SAMPLE = (0.6, 1.0)
SEARCH_MIN_CHILD = (1, 10)
SEARCH_MIN_GAIN = (0.0, 5.0)
SEARCH_L1 = (0.0, 5.0)
SEARCH_L2 = (0.1, 5.0)

# --- Attribution ------------------------------------------------------------------
TOP_SERVING, TOP_REPORT, TOP_CHART, TOP_GLOBAL = 5, 6, 8, 10
FEATURE_CATEGORIES = {
    "Demographics": ["SEX", "EDUCATION", "MARRIAGE", "AGE"],
    "Repayment Behavior": STATUS_COLUMNS + ["max_pay_delay", "avg_pay_delay", "months_late", "delay_trend"],
    "Financial Capacity": ["LIMIT_BAL"] + BILL_COLUMNS + PAID_COLUMNS + ["utilization_ratio", "payment_ratio"],
}
ENCODED_SUFFIX = "_encoded"
RAISES, LOWERS = "raises", "lowers"

# --- Regulation corpus --------------------------------------------------------------
FRONT_MATTER_END = "PRUDENTIAL REGULATIONS \nFOR \nCONSUMER FINANCING"
INTRO_SECTION = "Definitions & Minimum Requirements"
CITATION = (
    "State Bank of Pakistan. \"Prudential Regulations for Consumer Financing\" "
    "(Updated August 03, 2016). Banking Policy & Regulations Department."
)
CHUNK_SIZE, CHUNK_OVERLAP = 2000, 200
MIN_INTRO_CHARS, MIN_PART_CHARS = 100, 50  # a window must be longer than this
VECTOR_SIZE = 384
TOP_K, TOP_K_AGENT = 3, 5

# What Python's str.strip / str.split treat as white space. The spelling is
# understood by Java regular expressions and by RE2 alike.
WHITESPACE = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
HEADING_PATTERN = rf"REGULATION{WHITESPACE}+[RO]-[0-9]+"
REQUESTED_PATTERN = (
    rf"(?<![A-Z0-9])(?:REGULATION{WHITESPACE}+)?([RO]){WHITESPACE}*[-_]?{WHITESPACE}*([0-9]+)(?![A-Z0-9])"
)
SECTION_ID_PATTERN = rf"^REGULATION{WHITESPACE}+([RO])-([0-9]+)(?::| \(PART |$)"  # on upper case
OVERVIEW_PATTERN = r"(?i)(how many|list|total|what are).+regulation"
FENCE_PATTERN = r"(?m)^```(json)?|```$"

# --- Questions and answers ------------------------------------------------------------
QUESTION_AGGREGATE = (
    "What SBP regulation applies when a customer's aggregate clean "
    "credit card and personal loan exposure exceeds Rs 5,000,000?"
)
QUESTION_CLEAN = (
    "What SBP regulation applies when a customer's clean credit "
    "card limit exceeds Rs 2,000,000?"
)
QUESTION_TEMPLATE = (
    "What SBP regulations apply when a bank %ss "
    "a consumer financing application with credit limit %s?"
)
OVERVIEW_ANSWER = (
    "Based on the State Bank of Pakistan's Prudential Regulations for Consumer Financing, "
    "there are a total of %d specific regulations provided in this dataset: \n"
    "- %d 'R' (Risk) Regulations\n"
    "- %d 'O' (Operations) Regulations\n"
    "There is also a 'Definitions & Minimum Requirements' section."
)
OVERVIEW_SOURCE = "System Summary"

# --- Report ------------------------------------------------------------------------
REPORT = """
=======================================================
CREDIT UNDERWRITING REPORT
=======================================================
DATA VALIDATION
%s
RISK ASSESSMENT
   Decision            : %s
   Default Probability : %s%%
   Top Factors:
%s
COMPLIANCE CHECK
   %s
   Sources: %s
=======================================================
"""
WARNING_LINE = "   ⚠️  %s"
NO_WARNINGS = "   None"
FACTOR_RAISES, FACTOR_LOWERS = "   🔴 ", "   🟢 "
