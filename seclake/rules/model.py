"""Shape of a detection rule. Rules are plain data; matching is compiled from them."""

from __future__ import annotations

from dataclasses import dataclass, field

INFO, WARNING, ERROR = 0, 1, 2
SEVERITY_LABELS = {ERROR: "Error", WARNING: "Warning", INFO: "Info"}

CODE = "code-detectable"
REMINDER = "informational"
ADVISORY = "project-advisory"

# Category slugs and the labels shown for them.
CATEGORY_LABELS = {
    "auth-access-control": "Authentication & Access Control",
    "input-validation-xss": "Input Validation & XSS",
    "csrf-protection": "CSRF Protection",
    "cors-configuration": "CORS Configuration",
    "encryption-data-protection": "Encryption & Data Protection",
    "api-security": "API Security",
    "database-security": "Database Security",
    "file-handling": "File Handling",
    "secrets-credentials": "Secrets & Credentials",
    "frontend-security": "Frontend Security",
    "business-logic-payment": "Business Logic & Payment Security",
    "logging-monitoring": "Logging & Monitoring",
    "dependencies-supply-chain": "Dependencies & Supply Chain",
    "infrastructure-deployment": "Infrastructure & Deployment",
}


@dataclass(frozen=True)
class Rx:
    """A regular expression in ECMAScript notation. `flags` may hold i and m."""

    text: str
    flags: str = ""


def rx(text: str, flags: str = "") -> Rx:
    return Rx(text, flags)


# A plain string among the patterns of a rule is a case-insensitive literal.
Pattern = Rx | str


@dataclass(frozen=True)
class Rule:
    code: str
    category: str
    severity: int
    kind: str
    match: list[Pattern]
    unless: list[Pattern] = field(default_factory=list)
    unless_near: list[Rx] = field(default_factory=list)
    only_paths: list[Rx] = field(default_factory=list)
    skip_paths: list[Rx] = field(default_factory=list)
    info_paths: list[Rx] = field(default_factory=list)
    code_only: bool = False
    message: str = ""
    suggestion: str = ""
