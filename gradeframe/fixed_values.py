"""Fixed values that decide results: word lists, patterns, thresholds, weights.

They are stated here once, in plain text, and used by name elsewhere.
Patterns are Java regular expressions; ``(?U)`` makes ``\\w``, ``\\s`` and ``\\b``
follow Unicode so that accented letters count as letters.
"""

# --- question types -------------------------------------------------------
QUESTION_TYPES = [
    "mcq", "true_false", "fill_blank", "short_answer", "numerical", "open_ended", "diagram",
]
SIMILARITY_TYPES = ["open_ended", "short_answer"]
NO_RUBRIC_TYPES = ["mcq", "true_false", "numerical"]
JSON_REPLY_TYPES = ["open_ended", "short_answer", "diagram"]
OPTION_LETTERS = ["A", "B", "C", "D", "E"]

# --- hybrid score ---------------------------------------------------------
HYBRID_WEIGHTS = {
    "llm": 0.40, "similarity": 0.25, "rubric": 0.20, "keyword": 0.10, "length": 0.05,
}
WEIGHT_SUM_TOLERANCE = 0.01
FULL_LENGTH_RATIO = 0.6
NUMERIC_TOLERANCE = 0.01
NUMERIC_FLOOR = 0.001
DIAGRAM_FLOOR = 0.20
LOW_OCR_CONFIDENCE = 0.5
DEFAULT_MARKS = 2.0
PASS_PERCENT = 60
BORDERLINE_PERCENT = 40

# --- text -----------------------------------------------------------------
# every character the Unicode standard counts as white space
WHITE_SPACE = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003"
    "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
KEYWORD_STOP_WORDS = [
    "the", "and", "are", "for", "that", "this", "with", "from",
    "was", "not", "but", "can", "will", "also", "its", "used",
    "has", "have", "been", "into", "than", "then", "which",
    "when", "they", "some", "any", "each", "more", "very",
]
OCR_WORD_FIXES = {
    "backpropogation": "backpropagation",
    "alogrithm": "algorithm",
    "databse": "database",
    "recieve": "receive",
    "seperate": "separate",
    "occured": "occurred",
    "defenition": "definition",
    "dependant": "dependent",
    "existance": "existence",
    "grammer": "grammar",
    "neccessary": "necessary",
    "occurance": "occurrence",
    "persistance": "persistence",
    "priviledge": "privilege",
    "recomend": "recommend",
    "sucess": "success",
    "temparature": "temperature",
    "transfering": "transferring",
}
TECHNICAL_WORDS = [
    "algorithm", "preprocessing", "tokenization", "neuron",
    "backpropagation", "gradient", "sigmoid", "relu",
    "convolution", "transformer", "embedding", "cosine",
    "classifier", "regression", "hyperparameter", "dataset",
    "overfitting", "underfitting", "epoch", "batch",
    "learning", "training", "validation", "inference",
    "perceptron", "recurrent", "lstm", "attention", "bert",
    "scalability", "bandwidth", "latency", "throughput",
    "synchronous", "asynchronous", "microservices",
    "polymorphism", "encapsulation", "inheritance",
]

# --- answer extraction ----------------------------------------------------
OPTION_PATTERNS = [
    r"(?iUm)\b(?:answer|ans|option|choice|selected?|marked?)\s*[:\-=]?\s*\(?([A-E])\)?",
    r"(?iUm)^\s*\(?([A-E])\)?\s*$",
    r"(?iUm)\(([A-E])\)",
    r"(?iUm)\b([A-E])\)",
    r"(?iUm)[✓☑✗]\s*([A-E])",
    r"(?iUm)\b([A-E])\b",
]
TRUE_WORDS = r"(?U)\b(true|correct|yes|t)\b"
FALSE_WORDS = r"(?U)\b(false|incorrect|no|f)\b"
NUMBER = r"-?\d+(?:\.\d+)?"

# --- question classifier: (type, confidence, reason) in order -------------
CLASSIFIER_RULES = [
    ("mcq", 0.92, "lettered options or selection wording"),
    ("true_false", 0.95, "true-or-false wording"),
    ("fill_blank", 0.93, "blank to fill in"),
    ("numerical", 0.85, "computation verb and quantity word"),
    ("diagram", 0.90, "drawing verb"),
    ("short_answer", 0.80, "short factual question"),
    ("open_ended", 0.88, "essay verb"),
    ("open_ended", 0.50, "no rule matched"),
]
SHORT_QUESTION_WORDS = 30
CLASSIFY_OPTION_CASED = r"(?U)\b[a-eA-E]\s*[\)\.]\s+\w"
CLASSIFY_OPTION = [
    r"\(a\)|\(b\)|\(c\)|\(d\)",
    r"(?U)\bwhich\s+of\s+the\s+following\b",
    r"(?U)\bselect\s+(the\s+)?(correct|best|right)\b",
    r"(?U)\bchoose\s+(the\s+)?(correct|best|right|one)\b",
]
CLASSIFY_TRUE_FALSE = r"(?U)\b(true\s+or\s+false|state\s+whether|is\s+it\s+true|t\s*[\/|]\s*f)\b"
CLASSIFY_BLANK = r"(?U)_{2,}|\[.*?\]|\(\s*\.\.\.\s*\)|\bfill\s+in\b|\bcomplete\s+the\b"
CLASSIFY_COMPUTE = (
    r"(?U)\b(calculate|compute|find|solve|determine|evaluate|what\s+is\s+the\s+value"
    r"|how\s+many|how\s+much)\b"
)
CLASSIFY_QUANTITY = (
    r"(?U)\b(value|result|answer|total|sum|difference|product|quotient|area|volume|speed"
    r"|force|energy|mass|resistance|current)\b"
)
CLASSIFY_DRAW = r"(?U)\b(draw|sketch|label|illustrate|diagram|flowchart|draw\s+and\s+explain)\b"
CLASSIFY_SHORT = (
    r"(?U)\b(define|state|list|name|what\s+is|what\s+are|give\s+(an?\s+)?example|mention"
    r"|identify|who\s+is|when\s+was|where\s+is)\b"
)
CLASSIFY_ESSAY = (
    r"(?U)\b(explain|describe|discuss|analyze|analyse|compare|contrast|evaluate|elaborate"
    r"|justify|examine|assess|critically|in\s+detail)\b"
)
# compact classifier of the paper reader: (type, pattern, match lower-cased text?)
COMPACT_RULES = [
    ("mcq", r"(?U)\b[a-e]\s*[\)\.]\s+\w", False),
    ("mcq", r"\(a\)|\(b\)", True),
    ("true_false", r"(?U)\btrue\s+or\s+false\b", True),
    ("fill_blank", r"(?U)_{2,}|\bfill\s+in\b|\bcomplete\s+the\b", True),
    ("numerical", r"(?U)\b(calculate|compute|find\s+the\s+value|solve|determine)\b", True),
    ("diagram", r"(?U)\b(draw|sketch|label|illustrate|diagram|flowchart)\b", True),
    ("open_ended", r"(?U)\b(explain|describe|discuss|analyze|analyse|compare|design|evaluate"
                   r"|justify|examine|elaborate)\b", True),
    ("short_answer", r"(?U)\b(define|state|list|name|what\s+is|what\s+are|give|mention"
                     r"|identify|when|where|who)\b", True),
]

# --- line breaks and booklet segmentation ---------------------------------
LINE_BREAK = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"
PAGE_BREAK = "--- PAGE BREAK ---"
BOOKLET_MARKERS = [
    r"^\s*(\d{1,2})\s*[.)]\s+(.*)",
    r"^\s*\((\d{1,2})\)\s*\.?\s*(.*)",
    r"^\s*[Qq]\.?\s*(\d{1,2})\s*[.):]\s*(.*)",
    r"^\s*(?i:ans(?:wer)?)\s*\.?\s*(\d{1,2})\s*[.:)]\s*(.*)",
    r"^\s*(\d{1,2})\s*[.)]\s*$()",
    r"^\s*[Qq]\.?\s*(\d{1,2})\s*$()",
]
BOOKLET_CANDIDATE = r"^(?:\(?[0-9]|[Qq]\.?\s*[0-9]|(?i:ans(?:wer)?)\s*\.?\s*[0-9])"
BOOKLET_LAST_NUMBER = 20
BOOKLET_MIN_CHARS = 6
PART_B_FROM = 8

# --- answer-key segmentation ----------------------------------------------
KEY_MARKERS = [
    r"^\s*(\d{1,2})\s*[.):\],]\s+(.+)",
    r"^\s*(?i:Q)\.?\s*(\d{1,2})\s*[.):]?\s*(.+)",
    r"^\s*(?i:Answer|Ans)\.?\s*(\d{1,2})\s*[.):]\s*(.+)",
]
KEY_CANDIDATE = r"^(?:[0-9]|(?i:Q)\.?\s*[0-9]|(?i:Answer|Ans)\.?\s*[0-9])"
KEY_SKIP_CANDIDATE = r"^(?i:PART|SET|\(?OR)"
KEY_SKIP = [
    r"(?iU)^\s*PART\s*[-–—]?\s*[A-Z]\b",
    r"(?iU)^\s*SET\s*[-–—]?\s*[A-Z]\b",
    r"(?i)^\s*\(?OR\)?\s*$",
]
KEY_ANSWER_PREFIX = r"(?i)^\s*(?:Answer|Ans|Sol(?:ution)?)\s*[.:]\s*(.+)"
KEY_MIN_CHARS = 4
KEY_QUESTION_MAX_CHARS = 200

# --- question papers ------------------------------------------------------
# (pattern, field); the last matching line wins, the later rule within a line
HEADER_RULES = [
    (r"(?i)Course\s+Code\s*[:\-]?\s*\$?([A-Z0-9]+)", "course_code"),
    (r"(?i)Course\s+Name\s*[:\-]?\s*(.+)", "course_name"),
    (r"(?i)Subject\s*[:\-]?\s*(.+)", "course_name"),
    (r"(?i)Max\.?\s*Marks?\s*[:\-]?\s*(\d+)", "total_marks"),
    (r"(?i)Total\s+Marks?\s*[:\-]?\s*(\d+)", "total_marks"),
    (r"(?i)Time\s*[:\-]?\s*(\d[\d.]*)\s*Hours?", "duration_hours"),
    (r"(?i)Duration\s*[:\-]?\s*(\d[\d.]*)\s*Hours?", "duration_hours"),
    (r"(?i)Batch\s*[:\-]?\s*(\d{4}[-–]\d{4})", "batch"),
    (r"(?i)Sem(?:ester)?\s*[:\-]?\s*([IVX\d]+)", "semester"),
    (r"(?i)Date\s*[:\-]?\s*(\d{1,2}[./]\d{1,2}[./]\d{2,4})", "date"),
    (r"(?i)(CONTINUOUS\s+ASSESSMENT[^\n]*)", "exam_name"),
    (r"(?i)(CAE[\s\-]\d[^\n]*)", "exam_name"),
]
COURSE_NAME_CUT = r"(?i)\s+Sem\s*:"
DEFAULT_DURATION_HOURS = 2.0
PART_HEADER = r"(?iU)Part[-\s–—]*([A-Z])\b"
PART_LINE = r"(?iU)^Part[-\s–—]*([A-Z])\b"
PART_INSTRUCTIONS = r"(?i)(Answer\s+(?:ALL|ANY[^\n]*)\s*(?:the\s+)?questions?[^\n]*)"
MARKS_PRODUCT = r"\(\s*(\d+)\s*[xX×]\s*(\d+)\s*=\s*\d+\s*\)"
MARKS_EACH = r"(?i)(\d+)\s*Marks?\s*Each"
PART_A_MARKS = 2.0
OTHER_PART_MARKS = 12.0
MARKS_LINE = r"^\(?\s*\d+\s*[xX×]\s*\d+\s*[=]?\s*\d*\s*\)?$"
OR_LINE = r"(?i)^\s*\(?OR\)?\s*$"
COURSE_OUTCOME_TAG = r"(?U)\bC[Oo0][0-9]\b"
OUTCOME_CANDIDATE = r"C[Oo0][0-9]"
# Alternatives of one pattern, kept as a list because the institution's name is appended to them.
FLOW_SKIP_WORDS = [
    r"Reg\s*No", r"Q\.?No", r"Questions?", "INSTITUTE", "DEEMED", r"CONTINUOUS\s+ASSESSMENT",
    "Programme", r"Course\s+Code", r"Course\s+Name", "Batch", r"Max\.?\s*Marks", r"Time\s*:",
    r"Sem\s*:", r"Date\s*:", r"Answer\s+ALL", r"Answer\s+ANY",
]
FLOW_NOISE_WORDS = [
    r"Reg\s*No", "INSTITUTE", "DEEMED", "CONTINUOUS", "Programme", "Course", "Batch", "Max",
    "Time", "Sem", "Date", r"Q\.?No", r"Questions?",
]
FLOW_NUMBER_ONLY = r"^\s*(\d{1,2})\s*[.)]?\s*(?:C[Oo]\d)?\s*$"
FLOW_NUMBER_INLINE = r"^\s*(\d{1,2})\s*[.)]\s+(.+)"
FLOW_NUMBER_BARE = r"^\s*(\d{1,2})\s+([A-Z].{5,})"
FLOW_LAST_NUMBER = 30
FLOW_PENDING_MIN_CHARS = 9
FLOW_MIN_CHARS = 4
LIST_MARKERS = [
    r"^\s*(?i:Q\.?\s*)?(\d{1,2})\s*[.):\]]\s+(.+)",
    r"^\s*\((\d{1,2})\)\s*\.?\s+(.+)",
]
LIST_CANDIDATE = r"^(?:[0-9]|\([0-9]|[Qq]\.?\s*[0-9])"
LIST_LAST_NUMBER = 50
LIST_MIN_CHARS = 5
LIST_PART_LINE = r"(?iU)\bPART\s*[-–]?\s*([A-Z])\b"
LIST_PART_SKIP = r"(?i)^\s*PART\s*[-–]\s*[A-Z]"
LIST_INLINE_MARKS = r"\((\d+)\s*[Mm]arks?\)?\s*$"
LIST_OR_TAG = r"\s*\(OR\)\s*"
MINIMAL_ITEM = r"^\s*(\d{1,2})\s*[.)]\s+([A-Z][^\n]{10,})"
MINIMAL_LAST_NUMBER = 30

# --- recognised pages -----------------------------------------------------
AUTHORITATIVE_ENGINES = ["google", "mistral", "azure"]
LOCAL_ENGINES = ["paddle", "tesseract", "trocr"]
LAST_RESORT_ENGINE = "trocr"
LAST_RESORT_BELOW = 0.4
PAGE_MIN_CHARS = 11
WORD_WEIGHT = 0.7
CONFIDENCE_WEIGHT = 0.3

# --- drawn regions --------------------------------------------------------
REGION_LABELS = [
    "clock", "book", "cell phone", "laptop", "tv", "monitor",
    "figure", "diagram", "table", "chart", "graph", "formula",
    "flowchart", "circuit", "er_diagram", "tree", "drawing",
]
REGION_MIN_CONFIDENCE = 0.55
REGION_MIN_AREA = 0.01
OVERLAP_THRESHOLD = 0.3
CROP_PADDING = 10

# --- label corpora --------------------------------------------------------
LABEL_MIN_CHARS = 2
LABEL_MAX_CHARS = 60
LABEL_CHARSET = r"^[A-Za-z0-9\s'\-,.!?]+$"
LOADER_MIN_SIZE = (32, 8)
PREPARER_MIN_SIZE = (30, 15)
SIZE_TIERS = [(200, "small"), (800, "medium")]
CER_TIERS = [(0.08, "excellent"), (0.12, "good"), (0.20, "acceptable")]

# --- uploads --------------------------------------------------------------
UPLOAD_TYPES = {
    ".pdf": "application/pdf", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png",
}
UPLOAD_MAX_BYTES = 20 * 1024 * 1024

# Fixed result texts: feedback on objective answers, with the values they name.
FEEDBACK_UNCLEAR = "unclear"
FEEDBACK_WRONG = "❌ Incorrect. Detected '%s', correct answer is '%s'."
FEEDBACK_NO_OPTION = "Correct option not provided for MCQ grading."
FEEDBACK_NO_TRUTH = "Correct answer (True/False) not provided."
FEEDBACK_OPTION = "✅ Correct! You selected option %s."
FEEDBACK_TRUTH = "✅ Correct! The answer is %s."
FEEDBACK_NUMBER = "✅ Correct numerical answer: %s (expected %s)."
FEEDBACK_NUMBER_OFF = "❌ Numerical answer %s outside tolerance. Expected %s."

# Fixed result texts: why a request for measures of two score lists is rejected.
SCORES_NOT_NUMBERS = "Scores must be comma-separated floats."
SCORES_UNEVEN = "Length mismatch: %d vs %d"
SCORES_TOO_FEW = "At least 2 score pairs required."
