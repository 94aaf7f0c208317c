"""Values on which results depend, in one place."""

# Words that are no usage token.
USAGE_STOP_WORDS = (
    "where", "is", "are", "was", "were", "used", "use", "usages", "usage", "find", "calls", "call", "called",
    "import", "imports", "imported", "references", "refs", "defined", "definition", "of", "in", "on", "for", "to",
    "the", "a", "an",
)

# Words of a query that do not count.
QUERY_STOP_WORDS = (
    "the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "with", "without", "is", "are", "was", "were",
    "be", "been", "being", "does", "do", "did", "how", "what", "where", "when", "why", "which", "who", "whom",
    "this", "that", "these", "those", "it", "they", "them", "we", "you", "i",
)

# Reciprocal-rank fusion.
RRF_K = 60
DEFAULT_K = 20
CHANNEL_WEIGHTS = {
    "definition": {"symbols.name": 1.35, "symbols.qualname": 1.25, "symbols.name_fuzzy": 1.2, "symbols.qualname_fuzzy": 1.15, "symbols.identifiers": 1.05, "symbols.vec_summary": 1.0, "symbols.search_text": 0.95},
    "concept": {"files.vec_file": 1.15, "files.fts": 1.0, "symbols.vec_summary": 1.1, "symbols.search_text": 1.0, "symbols.identifiers": 0.95, "chunks.vec_code": 1.1, "chunks.search_text": 1.0, "chunks.identifiers": 0.95},
    "exact_text": {"chunks.code_text": 1.2, "symbols.code_text": 1.2},
    "similar_code": {"chunks.vec_code": 1.25, "symbols.vec_summary": 1.05, "chunks.search_text": 0.9, "symbols.search_text": 0.9},
    "usage": {"refs.token_texts_qualified": 1.15, "refs.token_texts": 1.0},
}
OTHER_VECTOR_WEIGHT, OTHER_TEXT_WEIGHT = 1.0, 0.9

# Priors.
EXPORT_BOOST = 1.2
REF_KIND_PRIORS = {"call": 1.15, "import": 1.1, "string_literal": 0.75}
TEST_PATH_PARTS = ("__tests__", "/test/", ".spec.", ".test.")
TEST_PATH_PRIOR = 0.6
OVERLAP_STEP, OVERLAP_MOST, NO_OVERLAP_PRIOR = 0.05, 0.25, 0.9
DIVERSITY_STEP = 0.25

# Full-text scores (k1, b) and the least distance of fuzzy names.
BM25_K1, BM25_B = 1.2, 0.75
MAX_EXPANSIONS = 50

# Version of the tables' schema, kinds of references by precedence.
SCHEMA_VERSION = 6
REVISION = "working"
REF_KIND_ORDER = ("import", "call", "identifier", "string_literal")

# What a listing never holds.
IGNORED_DIRS = (".git", ".querrick", "node_modules")
IGNORED_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "uv.lock", "poetry.lock", "Pipfile.lock",
    "Gemfile.lock", "composer.lock", "Cargo.lock", "go.sum", "gradle.lockfile", "packages.lock.json",
    "pubspec.lock", "Package.resolved",
)
IGNORED_PATTERNS = ("*.min.js", "*.min.css", "*.map", "*.d.ts.map")
IGNORE_FILES = (".gitignore", ".querrickignore")
BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".svg", ".tiff", ".tif",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".webm", ".flac", ".ogg",
    ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".exe", ".dll", ".so", ".dylib", ".bin",
    ".ttf", ".otf", ".woff", ".woff2", ".eot",
    ".wasm", ".node", ".pyc", ".pyo", ".class", ".o", ".a",
)
BINARY_PROBE_BYTES = 8192

# Languages by extension, for parsing and as a hint.
LANGUAGES = {
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".cs": "csharp", ".dart": "dart", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".php": "php",
}
MARKDOWN_EXTENSIONS = (".md", ".mdx", ".markdown")

# What scrubbing replaces, in order (pattern, ignore case, replacement).
SCRUB_RULES = (
    (r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", True, "[REDACTED_EMAIL]"),
    (r"sk-[A-Za-z0-9]{20,}", False, "[REDACTED_SECRET]"),
    (r"AIza[0-9A-Za-z\-_]{20,}", False, "[REDACTED_SECRET]"),
    (r"gh[pousr]_[A-Za-z0-9]{20,}", False, "[REDACTED_SECRET]"),
    (r"xox[baprs]-[A-Za-z0-9-]{10,}", False, "[REDACTED_SECRET]"),
    (r"[A-Za-z0-9+/]{80,}={0,2}", False, "[REDACTED_SECRET]"),
    (r"[a-f0-9]{64,}", True, "[REDACTED_SECRET]"),
)
CONTENT_KEYS = ("snippet", "code_text", "codetext", "text", "lines", "content", "docstring", "signature", "decorators")
TRUNCATED = "…(truncated)…"

# Sizes of pieces of files.
MAX_CHUNK_CHARS = 2000
SMALL_CHUNK_CHARS = 100
OVERLAP_LINES = 5
MARKDOWN_MAX_LINES, MARKDOWN_TARGET_LINES, MARKDOWN_BACK_LINES, MARKDOWN_OVERLAP_LINES, MARKDOWN_TAIL_FACTOR = 90, 60, 15, 7, 1.5
OWNED_CHUNK_CHARS = 1200
MAX_LITERAL_CHARS, MAX_CALL_CHARS = 512, 128

# Bounds of requests.
BOUNDS = {"k": (1, 100), "usages_k": (1, 2000), "limit": (1, 200), "samples": (1, 500), "max_lines": (1, 500)}
RESPONSE_BYTES, RESPONSE_BYTES_MOST = 50 * 1024, 100 * 1024
MAX_CODE_CHARS = 20_000

# Evaluation buckets (samples, k, seed mask) and the default seed.
EVAL_SEED = 1337
EVAL_BUCKETS = {"definition": (25, 10), "concept": (20, 50), "exact_text": (20, 5), "similar_code": (15, 10), "usage": (25, 20)}

# Changes of files (milliseconds).
DEBOUNCE_MS, BATCH_MS = 500, 2000

# What errors of embedding providers say (one of the groups, all words of it), and their retries.
RATE_LIMIT_SIGNS = (("429",), ("rate",), ("quota",))
TRANSIENT_SIGNS = (("api key expired", "400"), ("api key expired", "invalid_argument"))
TOO_LONG_SIGNS = (("maximum context length",), ("context length", "token"), ("exceeding max", "token"), ("exceeds max", "token"), ("maximum number of tokens",), ("input token count",))
RETRIES, FIRST_DELAY_S, MOST_DELAY_S = 10, 1.0, 60.0
