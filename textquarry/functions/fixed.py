"""Fixed values.

These tables must hold exactly these entries for results to be right (they are
data, not logic): extension tables, directory and file-name lists, limits and
marker strings.
"""

from __future__ import annotations

# --- document language by extension (file table) -----------------------------
DOCUMENT_LANGUAGES = {
    "python": (".py",),
    "rust": (".rs",),
    "javascript": (".js",),
    "typescript": (".ts",),
    "java": (".java",),
    "go": (".go",),
    "cpp": (".cpp", ".hpp"),
    "c": (".c", ".h"),
    "ruby": (".rb",),
    "php": (".php",),
    "csharp": (".cs",),
    "shell": (".sh",),
    "toml": (".toml",),
    "yaml": (".yaml", ".yml"),
    "json": (".json",),
    "markdown": (".md",),
}

# --- chunk language by extension (vector table) -------------------------------
CHUNK_LANGUAGES = {
    "python": (".py", ".pyw", ".pyi"),
    "rust": (".rs",),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx"),
    "java": (".java",),
    "kotlin": (".kt", ".kts"),
    "go": (".go",),
    "csharp": (".cs",),
    "cpp": (".cpp", ".cxx", ".cc", ".hpp"),
    "c": (".c", ".h"),
    "objective-c": (".m",),
    "objective-cpp": (".mm",),
    "swift": (".swift",),
    "scala": (".scala",),
    "ruby": (".rb",),
    "php": (".php",),
    "perl": (".pl", ".pm"),
    "sql": (".sql", ".psql"),
    "shell": (".sh", ".bash", ".zsh", ".fish"),
    "powershell": (".ps1", ".psm1"),
    "lua": (".lua",),
    "haskell": (".hs",),
    "ocaml": (".ml",),
    "elixir": (".ex", ".exs"),
    "dart": (".dart",),
    "groovy": (".groovy",),
    "r": (".r",),
    "julia": (".jl",),
    "jsonnet": (".jsonnet",),
    "cue": (".cue",),
}

# Extensions that count as code: everything with a chunk language, and Cython.
CODE_EXTENSIONS = tuple(e for exts in CHUNK_LANGUAGES.values() for e in exts) + (".pyx",)
DOC_EXTENSIONS = (
    ".md", ".mdx", ".rst", ".adoc", ".txt", ".json", ".yaml", ".yml", ".toml", ".ini",
    ".cfg", ".conf", ".csv", ".tsv", ".log", ".pdf", ".doc", ".docx", ".rtf",
)
CONFIG_EXTENSIONS = (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf")
DATA_EXTENSIONS = (".csv", ".tsv", ".jsonl", ".ndjson", ".parquet")

# Any path part equal to one of these marks generated output.
ARTIFACT_DIRS = (
    "egg-info", "dist-info", "site-packages", "node_modules", "__pycache__", ".mypy_cache",
    ".ruff_cache", ".pytest_cache", ".cache", "build", "dist", "venv", ".venv",
)
# Lower-cased file names that are documentation whatever their extension.
METADATA_NAMES = (
    "pkg-info", "metadata", "record", "wheel", "license", "license.txt", "copying",
    "authors", "install", "changelog", "readme",
)

# Content probes.
OBJC_PROBE = r"@interface|@implementation|@class\b"
CPP_PROBE = r"\bnamespace\b|\bstd::|\btemplate\s*<"
CODE_WORDS_PROBE = r"\b(class|def|function|package|namespace|public\s+static\s+void)\b"

# --- ignore rules --------------------------------------------------------------
INDEX_SKIP_DIRS = (
    ".git", "__pycache__", "node_modules", "target", "build", "dist", ".venv", "venv", ".tox",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", ".ruff", ".cache", "coverage", "htmlcov",
    "coverage_html", ".coverage", "site-packages",
)
INDEX_SKIP_EXTENSIONS = (
    ".pyc", ".so", ".o", ".a", ".dylib", ".dll", ".exe", ".bin", ".pdf", ".png", ".jpg",
    ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".zip", ".tar", ".gz", ".bz2", ".xz",
    ".mjs", ".html", ".htm", ".rmeta", ".rlib",
)
WATCH_SKIP_DIRS = (
    ".git", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", "build",
    "dist", "downloads", "eggs", ".eggs", "lib", "lib64", "parts", "sdist", "var", "wheels",
    ".installed.cfg", "develop-eggs", "htmlcov", "venv", ".venv", "ENV", "env", ".vscode",
    ".idea", "node_modules", "target", "coverage", ".coverage", ".cache",
)
WATCH_SKIP_EXTENSIONS = (
    ".pyc", ".pyo", ".pyd", ".so", ".o", ".a", ".dylib", ".dll", ".exe", ".bin", ".zip", ".tar",
    ".gz", ".bz2", ".xz", ".egg", ".mjs", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico",
    ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".log", ".tmp", ".temp", ".swp", ".swo",
    ".DS_Store",
)
MAX_FILE_BYTES = 1_000_000
BUILD_CACHE_TOKEN = "cargo_target_cache"
DEBOUNCE_SECONDS = 2.0

# --- embedding policy and limits -------------------------------------------------
NO_EMBED_EXTENSIONS = (".ipynb", ".jsonl")
NO_EMBED_NAMES = ("package-lock.json", "Cargo.lock", ".coverage")
JSONL_MAX_LINE_CHARS = 10_000
CHUNK_LINES = 100
CHUNK_OVERLAP = 10
HARD_CHARS = 12_000
HARD_WINDOW = 10_000
HARD_OVERLAP = 1_000
MAX_TOKENS = 2_048
TARGET_TOKENS = 1_024
TOKEN_OVERLAP = 128
VECTOR_DIM = 768

# --- JSONL records ------------------------------------------------------------------
RECORD_MAIN_FIELDS = ("task", "prompt", "statement", "description", "text", "content")
RECORD_SIGNATURE_FIELDS = ("signature", "sig", "signature_text")
RECORD_DOC_FIELDS = ("docstring", "doc", "explanation", "reasoning")
RECORD_SOLUTION_FIELDS = ("solution", "answer", "solution_text", "output")
RECORD_MIN_FREE_TEXT = 20
SOLUTION_MARK = "\n\n--SOLUTION--\n\n"

# --- reading and logging ---------------------------------------------------------------
READ_BYTES = 20_000
FETCH_BYTES = 50_000
READ_MARK = "\n\n[... truncated ...]"
SENSITIVE_HEADERS = (
    "authorization", "cookie", "x-api-key", "x-admin-key", "x-openai-session",
    "x-openai-session-token",
)
REDACTED = "<redacted>"
PREVIEW_CHARS = 500
PREVIEW_MARK = "... [truncated]"

# --- rerank weights: (flag, weight) in test order ---------------------------------------
RERANK_DEFAULT = (("is_doc", 0.85), ("is_config", 0.9), ("is_data", 0.9), ("is_code", 1.05))
RERANK_PREFER_CODE = (("is_code", 1.2), ("is_doc", 0.8), ("is_config", 0.85), ("is_data", 0.9))
MIN_DISTANCE = 1e-6

# Characters that end a line / count as whitespace in text (regex class bodies).
LINE_BREAK_CHARS = r"\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}"
SPACE_CHARS = r"\p{IsWhite_Space}\x1C-\x1F"
