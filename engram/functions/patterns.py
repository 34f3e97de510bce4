"""Pattern tables for secret detection and rule-based classification."""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES: sensitive-data patterns, in evaluation order.
# (name, pattern, severity, description).  Patterns are written in the
# common subset of Python / Java / RE2 syntax; ``java()`` adds the flags that
# make Java's line handling match the other engines.
# --------------------------------------------------------------------------
SECRET_PATTERNS = [
    ("OpenAI API Key", r"sk-[a-zA-Z0-9]{20,}", "critical", "OpenAI API key detected"),
    ("OpenAI Project Key", r"sk-proj-[a-zA-Z0-9\-_]{20,}", "critical", "OpenAI project API key detected"),
    ("GitHub Token", r"ghp_[a-zA-Z0-9]{36,}", "critical", "GitHub personal access token detected"),
    ("GitHub OAuth Token", r"gho_[a-zA-Z0-9]{36,}", "critical", "GitHub OAuth token detected"),
    ("GitHub App Token", r"ghu_[a-zA-Z0-9]{36,}", "critical", "GitHub user-to-server token detected"),
    ("AWS Access Key", r"AKIA[A-Z0-9]{16}", "critical", "AWS access key ID detected"),
    ("AWS Secret Key", r"(?i)aws.{0,20}secret.{0,20}['\"][a-zA-Z0-9/+=]{40}['\"]", "critical",
     "AWS secret access key detected"),
    ("Slack Token", r"xox[baprs]-[a-zA-Z0-9\-]{10,}", "critical", "Slack token detected"),
    ("Stripe Key", r"sk_live_[a-zA-Z0-9]{24,}", "critical", "Stripe live secret key detected"),
    ("Stripe Test Key", r"sk_test_[a-zA-Z0-9]{24,}", "high", "Stripe test secret key detected"),
    ("Google API Key", r"AIza[a-zA-Z0-9\-_]{35}", "critical", "Google API key detected"),
    ("Anthropic API Key", r"sk-ant-[a-zA-Z0-9\-_]{10,}", "critical", "Anthropic API key detected"),
    ("Bearer Token", r"(?i)bearer\s+[a-zA-Z0-9\-_\.]{20,}", "critical", "Bearer token detected"),
    ("Authorization Header", r"(?i)authorization['\"]?\s*[:=]\s*['\"]?bearer\s+[a-zA-Z0-9\-_\.]+", "critical",
     "Authorization header with bearer token detected"),
    ("Private Key", r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----", "critical", "Private key detected"),
    ("PGP Private Key", r"-----BEGIN\s+PGP\s+PRIVATE\s+KEY\s+BLOCK-----", "critical", "PGP private key detected"),
    ("Password Assignment", r"(?i)password\s*[=:]\s*['\"][^'\"]{8,}['\"]", "high", "Password assignment detected"),
    ("Password Value", r"(?i)(password|passwd|pwd)\s*[=:]\s*[^\s'\"]{8,}", "high", "Password value detected"),
    ("Password in URL", r"(?i)://[^:]+:[^@]{8,}@", "high", "Password in URL detected"),
    ("Database Connection String", r"(?i)(mysql|postgres|postgresql|mongodb|redis)://[^:]+:[^@]+@", "high",
     "Database connection string with credentials detected"),
    ("Env File Content", r"(?m)^[A-Z_]{2,}=\S{20,}$", "medium",
     "Environment variable assignment detected (possible .env content)"),
    ("Secret Assignment", r"(?i)(secret|token|apikey|api_key|password|passwd|pwd)\s*[=:]\s*['\"]?[a-zA-Z0-9\-_]{16,}",
     "high", "Secret/token assignment detected"),
    ("JWT Token", r"eyJ[a-zA-Z0-9\-_]+\.eyJ[a-zA-Z0-9\-_]+\.[a-zA-Z0-9\-_]+", "high", "JWT token detected"),
    ("Firebolt Client Secret", r"(?i)firebolt.{0,20}(client_secret|secret)\s*[=:]\s*['\"]?[a-zA-Z0-9\-_]{20,}",
     "critical", "Firebolt client secret detected"),
]

# FIXED VALUES: whole-string API key shapes.
API_KEY_SHAPES = [
    r"^sk-[a-zA-Z0-9]{20,}$",
    r"^ghp_[a-zA-Z0-9]{36,}$",
    r"^AKIA[A-Z0-9]{16}$",
    r"^sk_live_[a-zA-Z0-9]{24,}$",
    r"^AIza[a-zA-Z0-9\-_]{35}$",
]

# FIXED VALUES: password heuristics (bare field names are not values).
PASSWORD_FIELD_NAME = r"(?i)^(password|passwd|pwd|secret|token)$"
PASSWORD_ASSIGNMENT = r"(?i)password\s*[=:]\s*\S+"

SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2}


def has_group(pattern: str) -> bool:
    """True when the pattern has a capturing group (then the reported match
    is group 1, as a ``findall`` over such a pattern yields)."""
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if ch == "(" and not pattern.startswith("(?", i):
            return True
        i += 1
    return False


def java(pattern: str) -> str:
    """Java flavour: UNIX_LINES so that only \\n ends a line (``.``, ``^``
    and ``$`` then behave as in Python and RE2)."""
    return "(?d)" + pattern


def redaction_label(name: str) -> str:
    return "[REDACTED-" + name.upper().replace(" ", "-") + "]"


# --------------------------------------------------------------------------
# Rule-based classifier (used when no model callable is given).  One rule per
# documented auto-store pattern, in table order: the first matching rule sets
# category, subtype and importance; trigger phrases raise the importance.
# --------------------------------------------------------------------------
CLASSIFY_RULES = [
    ("bug fix or error resolution", r"(?i)(fixed|fixes|fix for|resolved|bug|error was)", "procedural", "workflow", 0.9),
    ("explains how something works", r"(?i)(works by|how it works|is used to|means that)", "semantic", "domain", 0.85),
    ("design decision", r"(?i)(decided|decision|we chose|architecture)", "episodic", "decision", 0.9),
    ("tool or API usage", r"(?i)(library|api|sdk|command line|cli)", "procedural", "tool_usage", 0.85),
    ("preference", r"(?i)(i prefer|i like|i dislike|i hate|i love|please always|please never)", "preference", "style", 0.8),
    ("configuration or setup", r"(?i)(configure|configuration|setup|set up|install)", "procedural", "workflow", 0.85),
    ("project knowledge", r"(?i)(project|repository|codebase)", "semantic", "project", 0.8),
    ("person with role", r"(?i)(team|manager|engineer|lead|owner)", "semantic", "entity", 0.7),
    ("workaround or gotcha", r"(?i)(workaround|gotcha|caveat)", "procedural", "pattern", 0.9),
    ("user correction", r"(?i)(actually|correction|that is wrong|not correct)", "semantic", "domain", 0.85),
]
IMPORTANCE_TRIGGERS = [
    (r"(?i)remember (this|that)", 0.95),
    (r"(?i)save this for later", 0.9),
    (r"(?i)this is important", 0.95),
    (r"(?i)don't forget", 0.9),
]
TEMPORAL_HINT = r"(?i)(today|tomorrow|yesterday|deadline|this week|next week)"


# --------------------------------------------------------------------------
# Literal pre-filters (our own optimisation, not part of the rule data): a
# pattern can only match a text that contains one of these substrings.  For
# case-sensitive patterns a plain substring search lets most texts skip the
# regex while every result stays exactly the regex's.
# --------------------------------------------------------------------------
REQUIRED_LITERALS = {
    "OpenAI API Key": ["sk-"],
    "OpenAI Project Key": ["sk-proj-"],
    "GitHub Token": ["ghp_"],
    "GitHub OAuth Token": ["gho_"],
    "GitHub App Token": ["ghu_"],
    "AWS Access Key": ["AKIA"],
    "AWS Secret Key": ["aws"],
    "Slack Token": ["xox"],
    "Stripe Key": ["sk_live_"],
    "Stripe Test Key": ["sk_test_"],
    "Google API Key": ["AIza"],
    "Anthropic API Key": ["sk-ant-"],
    "Bearer Token": ["bearer"],
    "Authorization Header": ["authorization"],
    "Private Key": ["-----BEGIN"],
    "PGP Private Key": ["-----BEGIN"],
    "Password Assignment": ["password"],
    "Password Value": ["password", "passwd", "pwd"],
    "Password in URL": ["://"],
    "Database Connection String": ["://"],
    "Env File Content": ["="],
    "Secret Assignment": ["secret", "token", "apikey", "api_key", "password", "passwd", "pwd"],
    "JWT Token": ["eyJ"],
    "Firebolt Client Secret": ["firebolt"],
}


def case_insensitive(pattern: str) -> bool:
    return pattern.startswith("(?i)")
