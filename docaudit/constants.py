"""Fixed values that decide results: word lists, lookup tables, thresholds, patterns.

Everything here is data. The operators turn the tables into small broadcast
dimension DataFrames or into CASE expressions; none of it grows with the input.
"""

# --- fixed values: snippet types -------------------------------------------------
SNIPPET_TYPES = [
    "SECTION", "SUBSECTION", "EQUATION", "FIGURE", "TABLE", "THEOREM",
    "LEMMA", "PROPOSITION", "COROLLARY", "ALGORITHM", "APPENDIX", "PARAGRAPH",
]
TEXT_TYPES = [
    "SECTION", "SUBSECTION", "PARAGRAPH", "THEOREM", "LEMMA",
    "PROPOSITION", "COROLLARY", "ALGORITHM", "APPENDIX",
]
THEOREM_TYPES = ["THEOREM", "LEMMA", "PROPOSITION", "COROLLARY"]
VISUAL_TYPES = ["FIGURE", "TABLE"]
CONTENT_TYPES = ["text", "image_url"]

# --- fixed values: type -> verifier (unlisted types go to "text") -----------------
TYPE_ROUTES = {
    "EQUATION": "math_equation",
    "FIGURE": "vision",
    "TABLE": "vision",
    "SECTION": "text",
    "SUBSECTION": "text",
    "THEOREM": "text",
    "LEMMA": "text",
    "PROPOSITION": "text",
    "ALGORITHM": "text",
    "APPENDIX": "text",
    "PARAGRAPH": "text",
}
DEFAULT_ROUTE = "text"

# --- fixed values: triage label -> verifier ("" = no specialist) ------------------
LABEL_ROUTES = {
    "math": "math_equation",
    "equation": "math_equation",
    "proof": "text",
    "statistics": "statistical",
    "statistical": "statistical",
    "numeric": "statistical",
    "citation": "citation",
    "reference": "citation",
    "vision": "vision",
    "figure": "vision",
    "table": "vision",
    "text": "text",
    "logic": "text",
    "none": "",
}

VERIFIERS = [
    "math_equation", "vision", "text", "statistical",
    "citation", "triage", "llm_only", "progressive_math",
]

# --- fixed values: confidence thresholds ------------------------------------------
THRESHOLDS = {
    "strict": {
        "math_equation": 0.7, "vision": 0.75, "text": 0.8, "statistical": 0.8,
        "citation": 0.8, "triage": 0.0, "llm_only": 0.8, "progressive_math": 0.7,
    },
    "lenient": {
        "math_equation": 0.7, "vision": 0.6, "text": 0.5, "statistical": 0.7,
        "citation": 0.6, "triage": 0.0, "llm_only": 0.5, "progressive_math": 0.7,
    },
}
FALLBACK_THRESHOLD = 0.5

# --- fixed values: triage and content rules ---------------------------------------
TRIAGE_WORDS = ["incorrect", "error", "contradict", "wrong"]
REVIEW_WORDS = ["incorrect", "wrong", "contradict", "flawed"]
CITATION_WORDS = ["already", "previously established"]
CONTRADICTION_WORDS = ["contradiction", "inconsist", "logical"]
UNCERTAINTY_THRESHOLD = 0.30
SWEEP_GRID = [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50]

CATEGORY_PROOF = "Equation / proof"
CATEGORY_FIGURE = "Figure duplication"
CATEGORY_DATA = "Data Inconsistency (figure-text)"
CATEGORY_STATISTICS = "Statistical reporting"

# --- fixed values: sizes ------------------------------------------------------------
SECTION_CHARS = 8000
SNIPPET_CHARS = 4000
OVERLAP_CHARS = 200
CHUNK_CHARS = 2000
CHUNK_OVERLAP = 200
REVIEW_CHARS = 60000
REVIEW_FLOOR_CHARS = 12000

# --- fixed values: location matching ------------------------------------------------
MATCH_ACCEPT = 0.6
MATCH_CATEGORY_BONUS = 0.25

# Ordered: the first pattern that hits names the type; group 1 holds the identifiers.
_NUM = r"\d+(?:\.\d+)*"
_NUM_LETTER = r"\d+[a-zA-Z]?"
_SEP = r"\s*[,&]\s*"
LOCATION_PATTERNS = [
    ("section", rf"(?:Section|Sec|§)\.?\s*({_NUM}(?:{_SEP}{_NUM})*)"),
    ("equation", rf"(?:Equation|Eq\.?)\s*\(?\s*({_NUM_LETTER}(?:{_SEP}{_NUM_LETTER})*)"),
    # several "Figure n" joined by , or &: first and last number are the identifiers
    ("figure", rf"(?:Figure|Fig\.?)\s*({_NUM_LETTER})(?:{_SEP}(?:Figure|Fig\.?)\s*({_NUM_LETTER}))+"),
    ("figure", rf"(?:Figure|Fig\.?)\s*({_NUM_LETTER}(?:{_SEP}{_NUM_LETTER})*)"),
    ("table", rf"Table\.?\s*({_NUM_LETTER}(?:{_SEP}{_NUM_LETTER})*)"),
    ("lemma", rf"Lemma\s*({_NUM}(?:{_SEP}{_NUM})*)"),
    ("theorem", rf"Theorems?\s*({_NUM}(?:{_SEP}{_NUM})*)"),
    ("proposition", rf"Proposition\s*({_NUM}(?:{_SEP}{_NUM})*)"),
    ("corollary", rf"({_NUM})\.?\s*Corollary"),
    ("corollary", rf"Corollary\s*({_NUM})"),
    ("claim", rf"Claim\s*({_NUM})"),
    ("appendix", rf"Appendix\s+([A-Za-z0-9]+(?:{_SEP}[A-Za-z0-9]+)*)"),
    ("page", rf"Page\s+(\d+(?:{_SEP}\d+)*)"),
    ("algorithm", rf"Algorithm\s+({_NUM_LETTER})"),
]

# --- fixed values: document structure ------------------------------------------------
HEADER_LINE = r"(?md)^(#{1,4})\s*(\d+(?:\.\d+)*)?\.?\s*(.+?)\s*$"
DISPLAY_EQUATION = (
    r"(?s)\\\[(.*?)\\\]|\$\$(.*?)\$\$"
    r"|\\begin\{equation\*?\}(.*?)\\end\{equation\*?\}"
    r"|\\begin\{align\*?\}(.*?)\\end\{align\*?\}"
    r"|\\begin\{eqnarray\*?\}(.*?)\\end\{eqnarray\*?\}"
)
INLINE_EQUATION = r"(?d)(?<!\$)\\\((.+?)\\\)(?!\$)"
EQUATION_LABEL = r"\\label\{([^}]+)\}"
MARKDOWN_TABLE = r"\|[^\n]+\|\s*\n\|[\s\-:|]+\|\s*\n(?:\|[^\n]+\|\s*\n)*"
SEPARATOR_ROW = r"^\|[\s\-:|]+\|$"
THEOREM_HEAD = r"\*\*(Theorem|Lemma|Proposition|Corollary|Claim)\s*(\d+(?:\.\d+)*(?:,\d+(?:\.\d+)*)*)?\.?\*\*\s*"
STATEMENT_END = r"\n\*\*(?:Theorem|Lemma|Proposition|Corollary|Claim|Proof)|\n#{1,4}\s"
PROOF_BLOCK = r"(?s)\*\*Proof\.?\*\*\s*(.+?)(?=\n\*\*(?:Theorem|Lemma|Proposition|Corollary)|\n#{1,4}\s|\z)"
FIGURE_CAPTION = r"(?id)(?:Figure|Fig\.?)\s*\d+[a-zA-Z]?(?:[\.:]?\s*(.+?))?(?:\n|\z)"
TABLE_CAPTION = r"(?id)Table\s*\d+[a-zA-Z]?(?:[\.:]?\s*(.+?))?(?:\n|\z)"
# reference in running text -> tag, applied in this order
REFERENCE_TAGS = [
    (r"(?iu)(?:Figure|Fig\.?|FIGURE)\s+(\d+[a-zA-Z]?)", "[IMAGE:FIGURE_$1]"),
    (r"(?iu)Table\s+(\d+[a-zA-Z]?)", "[TABLE:TABLE_$1]"),
    (r"(?iu)(?:Equation|Eq\.?)\s*\(?\s*(\d+[a-zA-Z]?)\s*\)?", "[EQUATION:EQ_$1]"),
]
STEP_MATH = [r"(?d)\\\((.*?)\\\)", r"(?d)\$(.*?)\$"]
BRACKET_CITATION = r"\[\d+(?:,\s*\d+)*\]"
NAME_CITATION = r"\([A-Z][a-z]+\s*(?:et al\.?)?\s*,\s*\d{4}[a-z]?\)"

# --- fixed values: symbol domains -----------------------------------------------------
DOMAIN_PATTERNS = [
    (r"\\in\s*\\mathbb\{N\}", "natural"),
    (r"\\in\s*\\mathbb\{Z\}", "integer"),
    (r"\\in\s*\\mathbb\{Q\}", "rational"),
    (r"\\in\s*\\mathbb\{R\}(?!\^)", "real"),
    (r"\\in\s*\\mathbb\{R\}\^", "matrix"),
    (r"\\in\s*\\mathbb\{C\}", "complex"),
    (r">\s*0", "positive_real"),
    (r"\\ge\s*0", "nonnegative_real"),
    (r"\\neq\s*0", "nonzero"),
]
DOMAIN_IMPLIES = {
    "integer": ["integer", "rational", "real", "complex"],
    "natural": ["integer", "rational", "real", "complex", "nonnegative"],
    "rational": ["rational", "real", "complex"],
    "real": ["real", "complex"],
    "complex": ["complex"],
    "positive_real": ["real", "complex", "positive"],
    "nonnegative_real": ["real", "complex", "nonnegative"],
    "nonzero": ["nonzero", "complex"],
    "matrix": [],
    "function_space": [],
    "unknown": ["complex"],
}
# condition text -> predicates that satisfy it
OBLIGATION_RULES = [
    (["!=", "≠", "neq", "nonzero"], ["nonzero", "positive"]),
    (["> 0", "positive"], ["positive"]),
    (["real"], ["real"]),
    (["integer"], ["integer"]),
]

# --- fixed values: numeric sampling ----------------------------------------------------
SAMPLE_POINTS = [
    (2, 1), (3, 2), (5, 3), (7, 4), (-2, 1), (-3, 2), (11, 5), (-7, 4),
    (4, 3), (-5, 3), (13, 6), (9, 7), (-11, 5), (6, 5), (-13, 6), (8, 5),
]
SAMPLE_COUNT = 30
NONZERO_EPS = 1e-9

# --- fixed values: step-case splits ------------------------------------------------------
STEP_SPLITS = [
    ("gsm8k", "GSM8K", "Grade-school math", 400),
    ("math", "MATH", "Competition-level", 1000),
    ("olympiadbench", "OlympiadBench", "Olympiad-level", 1000),
    ("omnimath", "OmniMath", "Advanced", 1000),
]

REPORT_SKIP_FILES = ["batch_results.json", "metrics.json", "predictions.json", "confusion_matrix.json"]

# Python's notion of whitespace, so trimmed text agrees with str.strip().
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
