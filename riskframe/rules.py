"""Rule tables and other fixed values.

Every table here is the default of a parameter: the operators take the rules they apply, so the
same plans run with corpus-specific rules.  Patterns are written in Python's regex dialect and
translated by :mod:`riskframe.functions.patterns`.
"""

from __future__ import annotations

from typing import NamedTuple

# --- fixed values: everything below but the three record types ------------------------------------

ASSIGNMENT_PATTERN = r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*="
FUNCTION_PATTERN = r"\s*def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("
REQUIREMENT_PATTERN = r"\s*([A-Za-z0-9_.\-]+(?:\[[A-Za-z0-9_,.\-]+\])?)\s*(==|~=|>=|<=|!=|>|<)?\s*([^\s]+)?"


class BehaviorRule(NamedTuple):
    """One line rule, matched on the lower-cased line without its string literals.

    ``hint`` names plain texts, separated by ``|``, one of which every matching line holds; it feeds
    the cheap file and line gate.  A rule without a hint is gated by its own pattern.
    """

    key: str
    pattern: str
    points: float
    hint: str | None = None
    label: str | None = None

    @property
    def message(self) -> str:
        return self.label or f"Suspicious usage detected: {self.key}"


class SecretRule(NamedTuple):
    """One secret rule, matched on the raw line; the pattern is also the finding key."""

    pattern: str
    label: str
    points: float

    @property
    def key(self) -> str:
        return self.pattern


class PlanLimits(NamedTuple):
    """Caps of one plan; ``None`` means unlimited."""

    line_limit: int | None
    repo_file_limit: int | None
    repo_size_limit_bytes: int | None
    daily_scan_limit: int | None


# --- fixed values -------------------------------------------------------------------------------

BEHAVIOR_RULES = [
    BehaviorRule("eval(", r"(?<![\w.])eval\s*\(", 25, "eval"),
    BehaviorRule("exec(", r"(?<![\w.])exec\s*\(", 25, "exec"),
    BehaviorRule("os.system", r"\bos\.system\s*\(", 30, "os.system"),
    BehaviorRule("subprocess", r"\bsubprocess\b", 15, "subprocess"),
    BehaviorRule("child_process", r"\bchild_process\b", 15, "child_process"),
    BehaviorRule("requests.post", r"\brequests\.post\s*\(", 4, "requests."),
    BehaviorRule("requests.get", r"\brequests\.get\s*\(", 2, "requests."),
    BehaviorRule("socket", r"\bsocket\b", 8, "socket"),
    BehaviorRule("fetch(", r"(?<![\w.])fetch\s*\(", 0.5, "fetch"),
    BehaviorRule("open(", r"(?<![\w.])open\s*\(", 0.5, "open"),
    BehaviorRule("base64", r"\bbase64\b", 0.25, "base64"),
    BehaviorRule("__import__", r"(?<![\w.])__import__\s*\(", 8, "__import__"),
    BehaviorRule("importlib.import_module", r"\bimportlib\.import_module\s*\(", 6, "importlib."),
    BehaviorRule("pickle.loads", r"\bpickle\.loads\s*\(", 20, "pickle."),
    BehaviorRule("pickle.load", r"\bpickle\.load\s*\(", 20, "pickle."),
    BehaviorRule("marshal.loads", r"\bmarshal\.loads\s*\(", 18, "marshal."),
    BehaviorRule("marshal.load", r"\bmarshal\.load\s*\(", 18, "marshal."),
    BehaviorRule("yaml.load", r"\byaml\.load\s*\(", 14, "yaml."),
    BehaviorRule("dill.loads", r"\bdill\.loads\s*\(", 18, "dill."),
    BehaviorRule("shelve.open", r"\bshelve\.open\s*\(", 8, "open"),
    BehaviorRule("urllib.request.urlopen", r"\burllib\.request\.urlopen\s*\(", 3, "urllib."),
    BehaviorRule("urllib.request.urlretrieve", r"\burllib\.request\.urlretrieve\s*\(", 5, "urllib."),
    BehaviorRule("urllib.request.Request", r"\burllib\.request\.Request\s*\(", 2, "urllib."),
    BehaviorRule("download helper", r"\b(curl|wget)\b", 8, "curl|wget"),
    BehaviorRule("bytes.fromhex", r"\bbytes\.fromhex\s*\(", 4, "fromhex"),
]

SECRET_RULES = [
    SecretRule(r"AKIA[0-9A-Z]{16}", "Possible AWS access key", 30),
    SecretRule(r"-----BEGIN PRIVATE KEY-----", "Possible private key", 40),
    SecretRule(r"sk-[A-Za-z0-9]{20,}", "Possible API secret key", 30),
    SecretRule(r"AIza[0-9A-Za-z\-_]{35}", "Possible Google API key", 25),
]

# Texts that mark a line as an external source of data; seen on lower-cased lines.
TAINT_SOURCES = [
    r"\binput\s*\(",
    r"\brequest\.",
    r"\brequests?\.(get|post|put|delete|patch|request)\s*\(",
    r"\bform\b",
    r"\bargs\b",
    r"\bjson\b",
    r"\bsys\.argv\b",
    r"\bos\.environ\b",
    r"\bgetenv\s*\(",
    r"\blocalStorage\b",
    r"\bsessionStorage\b",
    r"\bdocument\.cookie\b",
    r"\bwindow\.location\b",
]
# Words of which a text must hold one before any of these patterns can match.
TAINT_WORDS = [
    "input", "request", "form", "args", "json", "sys.argv", "os.environ", "getenv", "localStorage", "sessionStorage",
    "document.cookie", "window.location",
]

SINK_KEYS = [
    "eval(", "exec(", "os.system", "subprocess", "child_process",
    "pickle.loads", "pickle.load", "marshal.loads", "marshal.load", "yaml.load", "dill.loads",
    "__import__", "importlib.import_module",
]

# Keys whose call arguments can be read off a line.
CALL_KEYS = [
    "eval(", "exec(", "os.system", "subprocess", "child_process",
    "requests.post", "requests.get", "fetch(", "open(", "__import__", "importlib.import_module",
    "pickle.loads", "pickle.load", "marshal.loads", "marshal.load", "yaml.load", "dill.loads",
    "urllib.request.urlopen", "urllib.request.urlretrieve", "urllib.request.Request",
]
# ... of which these may name any member before the parenthesis.
MEMBER_CALL_KEYS = ["subprocess", "child_process"]

DYNAMIC_MARKERS = ['f"', "f'", ".format(", "%", "+", "[", "]", "{", "}"]

# Points taken off a call whose only argument is a fixed literal; every other key loses 4.
LITERAL_DISCOUNTS = {
    "os.system": 8, "eval(": 2, "exec(": 2,
    "pickle.loads": 1, "pickle.load": 1, "marshal.loads": 1, "marshal.load": 1, "dill.loads": 1,
}
DEFAULT_LITERAL_DISCOUNT = 4

TRUSTED_NETWORK_KEYS = ["urllib.request.urlopen", "urllib.request.Request"]
TRUSTED_NETWORK_FUNCTIONS = ["download_repo_zip", "fetch_json", "query_osv_batch", "fetch_osv_vulnerability"]
TRUSTED_NETWORK_HINTS = ["osv", "api.osv.dev", "codeload.github.com", "github.com", "certifi.where"]

# Call targets watched in parsed Python text and the rule key each one reports.
CALL_TARGETS = {
    "eval": "eval(", "exec": "exec(", "open": "open(", "__import__": "__import__",
    "os.system": "os.system", "importlib.import_module": "importlib.import_module",
    "pickle.loads": "pickle.loads", "pickle.load": "pickle.load",
    "marshal.loads": "marshal.loads", "marshal.load": "marshal.load",
    "yaml.load": "yaml.load", "dill.loads": "dill.loads",
    "requests.get": "requests.get", "requests.post": "requests.post",
    "urllib.request.urlopen": "urllib.request.urlopen",
    "urllib.request.urlretrieve": "urllib.request.urlretrieve",
    "urllib.request.Request": "urllib.request.Request",
}
CALL_TARGET_MODULES = {"subprocess": "subprocess"}

CODE_EXTENSIONS = [
    ".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".java", ".rb", ".php", ".cs", ".cpp", ".c", ".rs",
    ".sh", ".swift", ".kt", ".sql", ".html", ".css", ".json", ".yaml", ".yml", ".xml",
]
MANIFEST_ECOSYSTEMS = {"requirements.txt": "PyPI", "package.json": "npm"}

GENERIC_INTENTS = [
    "", "scan this", "scan this code", "scan this file", "test", "testing", "check this",
    "review this", "analyze this", "scan this public github repo", "repo scan", "code scan",
]
MIN_INTENT_LENGTH = 12

PLAN_LIMITS = {
    "free": PlanLimits(2_000, 25, 1_000_000, 5),
    "pro": PlanLimits(20_000, 200, 10_000_000, 50),
    "admin": PlanLimits(None, None, None, None),
}
DEFAULT_PLAN = "free"

ADVISORY_POINTS = {"CRITICAL": 16, "HIGH": 12, "MEDIUM": 7, "MODERATE": 7, "LOW": 3, "UNKNOWN": 5}

# Path classes of code files, first match wins: (contained texts, leading texts, trailing texts, weight).
CODE_PATH_WEIGHTS = [
    (["/tests/", "/test/"], [], ["_test.py"], 0.35),
    (["/examples/", "/example/"], [], [], 0.45),
    (["/templates/"], [], [], 0.5),
    (["/docs/"], ["docs/"], [], 0.4),
    (["/.github/workflows/", "/workflows/"], [], [], 0.3),
    ([], [], [".yml", ".yaml"], 0.4),
    ([], [], [".html"], 0.5),
]
MANIFEST_PATH_WEIGHTS = [
    (["/tests/", "/test/"], [], [], 0.35),
    (["/examples/", "/example/"], [], [], 0.4),
    (["/demo/", "/demos/"], [], [], 0.4),
    (["/sample/", "/samples/"], [], [], 0.45),
    (["/fixture/", "/fixtures/"], [], [], 0.35),
    (["/docs/"], [], [], 0.3),
    (["/data/exploits/", "/exploit/", "/exploits/"], [], [], 0.25),
]

# Blocks left out of scanning: (leading text, text also needed on the line, lines that end it).
# Order is the order in which an open block claims a line.
BRACKET_END = ("]", "],")
BRACE_END = ("}",)
EXCLUDED_BLOCKS = [
    ("SUSPICIOUS_PATTERNS", "[", BRACKET_END),
    ("SECRET_PATTERNS", "[", BRACKET_END),
    ("DEPENDENCY_SEVERITY_POINTS", "{", BRACE_END),
    ("DEPENDENCY_MANIFEST_FILES", "{", BRACE_END),
    ("explanations = {", "", BRACE_END),
    ("return {", "why_risky", None),  # None: ends when its braces balance
]
EXCLUDED_FUNCTIONS = [
    "loadSafeExample", "loadSuspiciousExample", "loadSecretExample", "loadEncodedExecutionExample",
]

# File-level signals, searched in the lower-cased text without string literals.
SIGNALS = {
    "exec": r"(?<![\w.])exec\s*\(|(?<![\w.])eval\s*\(",
    "decode": r"base64\.(b64decode|standard_b64decode|urlsafe_b64decode)\s*\(|bytes\.fromhex\s*\(",
    "download": r"requests\.(get|post)\s*\(|urllib\.request\.(urlopen|urlretrieve|request)\s*\("
                r"|(?<![\w.])fetch\s*\(|\b(curl|wget)\b",
    "system": r"\bos\.system\s*\(|\bsubprocess\b|\bchild_process\b|(?<![\w.])exec\s*\(|(?<![\w.])eval\s*\(",
    "chr": r"\bchr\s*\(",
}
# Words of which a text must hold one before a signal's pattern can match.
SIGNAL_WORDS = {
    "exec": ["exec", "eval"],
    "decode": ["base64.", "bytes.fromhex"],
    "download": ["requests.", "urllib.request.", "fetch", "curl", "wget"],
    "system": ["os.system", "subprocess", "child_process", "exec", "eval"],
    "chr": ["chr"],
}
BLOB_LENGTH = 180
CHR_CHAIN_LENGTH = 4

# (key, points, message, case-insensitive pattern of the reported line)
HEURISTICS = [
    ("obfuscated_execution", 18,
     "Suspicious behavior detected: encoded data appears to be executed",
     r"base64\.(b64decode|standard_b64decode|urlsafe_b64decode)\s*\(|bytes\.fromhex\s*\("),
    ("download_execute_chain", 14,
     "Suspicious behavior detected: remote content may be downloaded and then executed",
     r"os\.system\s*\(|subprocess|child_process|(?<![\w.])exec\s*\(|(?<![\w.])eval\s*\("),
    ("high_entropy_blob", 6,
     "Suspicious behavior detected: long encoded-looking string found",
     r"[A-Za-z0-9+/]{180,}={0,2}"),
    ("chr_chain", 7,
     "Suspicious behavior detected: repeated chr() calls may be hiding a string",
     r"\bchr\s*\("),
]

# (category, pattern), in report order; searched like the signals.
TOUCHES = [
    ("network",
     r"https?://|(?<![\w.])fetch\s*\(|\brequests\.(get|post|put|delete|patch|request)\s*\("
     r"|\burllib\.request\.(urlopen|request|urlretrieve)\b|\bsocket\b|\b(curl|wget)\b"),
    ("files",
     r"(?<![\w.])open\s*\(|\.write\s*\(|read_text\s*\(|write_text\s*\(|read_bytes\s*\(|write_bytes\s*\("),
    ("system execution",
     r"(?<![\w.])exec\s*\(|(?<![\w.])eval\s*\(|\bos\.system\s*\(|\bsubprocess\b|\bchild_process\b"),
    ("dynamic imports", r"\b__import__\s*\(|\bimportlib\.import_module\s*\("),
    ("deserialization",
     r"\bpickle\.loads?\s*\(|\bmarshal\.loads?\s*\(|\bdill\.loads?\s*\(|\byaml\.load\s*\(|\bshelve\.open\s*\("),
    ("obfuscation", r"\bbase64\b|\bbytes\.fromhex\s*\(|\bchr\s*\("),
]
# The same for the categories.
TOUCH_WORDS = {
    "network": ["http", "fetch", "requests.", "urllib.request.", "socket", "curl", "wget"],
    "files": ["open", ".write", "read_text", "write_text", "read_bytes", "write_bytes"],
    "system execution": ["exec", "eval", "os.system", "subprocess", "child_process"],
    "dynamic imports": ["__import__", "importlib.import_module"],
    "deserialization": ["pickle.load", "marshal.load", "dill.load", "yaml.load", "shelve.open"],
    "obfuscation": ["base64", "bytes.fromhex", "chr"],
}
SECRETS_TOUCH = "secrets"
DEPENDENCIES_TOUCH = "dependencies"

# (touch, penalty, message, words of the intent that silence it); only for a meaningful intent.
INTENT_CHECKS = [
    ("network", 1.0, "Code uses network behavior not clearly mentioned in the intent.",
     ["api", "fetch", "request", "http", "network", "online", "web", "repo", "github", "download"]),
    ("files", 1.0, "Code reads or writes files not clearly mentioned in the intent.",
     ["file", "save", "write", "export", "download", "upload", "repo", "github", "read"]),
    ("system execution", 2.5, "Code runs system-level commands not clearly mentioned in the intent.",
     ["terminal", "shell", "command", "system", "script", "execute", "cli"]),
    ("dynamic imports", 2.0,
     "Code dynamically loads modules in a way that is not clearly mentioned in the intent.",
     ["plugin", "module", "import", "extension", "dynamic"]),
    ("deserialization", 2.0, "Code deserializes data in a way that is not clearly mentioned in the intent.",
     ["pickle", "yaml", "deserialize", "serialization", "load saved model", "cache"]),
]
SECRET_PENALTY = 8.0
SECRET_MISMATCH = "Code appears to contain secrets or credentials, which may be unsafe."

BEHAVIOR_SENTENCES = {
    "network": "Makes outbound network requests or downloads remote content.",
    "files": "Reads or writes local files.",
    "system execution": "Executes system-level commands.",
    "dynamic imports": "Dynamically loads code or modules at runtime.",
    "deserialization": "Loads serialized data that may be unsafe if the source is untrusted.",
    "obfuscation": "Contains encoding or obfuscation signals that may hide behavior.",
    "secrets": "Contains possible credentials or secret values.",
}
CHAIN_SENTENCES = {
    "download_execute_chain": "May download remote content and then execute it.",
    "obfuscated_execution": "May decode hidden content and then execute it.",
}
MISMATCH_SENTENCE = "Includes behavior that may not match the stated request."
QUIET_SENTENCE = "No obvious risky behavior was detected in this scan."
QUIET_REPO_SENTENCE = "No obvious risky behavior was detected in this repo scan."
NO_MAJOR_SENTENCE = "No major code-behavior risks were detected in the scanned files."
DEPENDENCIES_SENTENCE = "Dependency vulnerability findings were also detected in manifest files."

RED_POINTS = 35
YELLOW_POINTS = 10

# (risk level, highest trust score that still gets it, label, emoji, colour, message)
BADGES = [
    ("red", 40, "High Risk", "\U0001f534", "red", "This code needs careful review before running."),
    ("yellow", 70, "Review Carefully", "\U0001f7e1", "goldenrod",
     "Some caution is warranted before trusting this code."),
    (None, 100, "Safe", "\U0001f7e2", "green", "Looks relatively safe based on this scan."),
]
README_BADGE_COLORS = [(90, "brightgreen"), (75, "green"), (60, "yellow"), (40, "orange"), (None, "red")]

REPO_DAMPING = [(35, 85), (15, 90)]  # (raw points from, percent kept)
DEPENDENCY_POINTS_CAP = 35.0
DEPENDENCY_POINTS_SHARE = 0.75

UNSUPPORTED_VERSION_PREFIXES = [
    "git+", "git://", "github:", "file:", "link:", "workspace:", "http://", "https://", "npm:",
    "path:", "*", "latest",
]
PACKAGE_JSON_SECTIONS = ["dependencies", "devDependencies", "optionalDependencies", "peerDependencies"]
INDIRECT_REQUIREMENT_PREFIXES = ["-r ", "--requirement ", "-c ", "--constraint ", "-e ", "--editable "]

SKIP_INDIRECT = "Nested, editable, or indirect requirement not queried in this first version."
SKIP_UNPARSED = "Could not confidently parse this dependency line."
SKIP_UNPINNED = "Unpinned dependency version could not be queried reliably."
SKIP_COMPLEX = "Complex version specifier is not supported in this first version."
SKIP_JSON = "package.json could not be parsed as valid JSON."
SKIP_JSON_ENTRY = "{section} entry uses a complex or non-registry specifier."

MAX_ALIASES = 5
MAX_FIXED_VERSIONS = 5
MAX_EXPLANATION_CHARS = 700
MAX_SKIPPED_REPORTED = 25
REPO_HOSTS = ["github.com", "www.github.com"]
REPO_URL_ERROR = "Please provide a valid public GitHub repository URL."
