"""Passwords, keys and other credentials written into text.

The patterns follow the publicly documented shapes of each credential.
"""

from .model import CODE, ERROR, INFO, REMINDER, WARNING, Rule, rx

CATEGORY = "secrets-credentials"

RULES = [
    Rule(
        "CRED001", CATEGORY, ERROR, CODE,
        match=[
            rx(r"""(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|\btoken)\s*[:=]\s*['"`][^'"`\s]{4,}['"`]""", "i"),
        ],
        unless=[
            rx(r"process\.env|os\.environ|getenv\s*\(", "i"),
            rx(r"""['"`](?:<[^>]+>|\$\{[^}]+\}|x{3,}|\*{3,})['"`]""", "i"),
        ],
        code_only=True,
    ),
    Rule(
        "CRED002", CATEGORY, ERROR, CODE,
        match=[
            rx(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
            rx(r"""aws_secret_access_key\s*[:=]\s*['"]?[A-Za-z0-9/+=]{40}\b""", "i"),
        ],
    ),
    Rule(
        "CRED003", CATEGORY, ERROR, CODE,
        match=[
            rx(r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY"),
        ],
    ),
    Rule(
        "CRED004", CATEGORY, ERROR, CODE,
        match=[
            rx(r"\bgh[pousr]_[A-Za-z0-9]{36}"),
            rx(r"\bgithub_pat_[A-Za-z0-9_]{22,}"),
            rx(r"\bglpat-[A-Za-z0-9_-]{20}"),
        ],
    ),
    Rule(
        "CRED005", CATEGORY, WARNING, CODE,
        match=[
            rx(r"""(?:key|token|secret|signature|hash)\w*\s*[:=]\s*['"][A-Za-z0-9+/=_-]{32,}['"]""", "i"),
        ],
        unless=[
            rx(r"process\.env|os\.environ", "i"),
            rx(r"\bt\s*\(|integrity\s*=|sha(?:256|384|512)-"),
        ],
    ),
    Rule(
        "CRED006", CATEGORY, WARNING, CODE,
        match=[
            rx(r"""process\.env\.\w*(?:SECRET|PASSWORD|KEY|TOKEN)\w*\s*(?:\|\||\?\?)\s*['"][^'"]+['"]""", "i"),
            rx(r"""os\.(?:getenv|environ\.get)\s*\(\s*['"]\w*(?:SECRET|PASSWORD|KEY|TOKEN)\w*['"]\s*,\s*['"][^'"]+['"]""", "i"),
        ],
    ),
    Rule(
        "CRED007", CATEGORY, WARNING, REMINDER,
        match=[
            rx(r"""['"/](?:\.env(?:\.\w+)?|credentials\.json|serviceAccountKey\w*\.json)['"]""", "i"),
        ],
    ),
    Rule(
        "CRED008", CATEGORY, INFO, REMINDER,
        match=[
            rx(r"(?:rotate|rotation)\w*.{0,40}(?:secret|key|credential)", "i"),
            rx(r"(?:SecretsManager|KeyVault|secretmanager)", "i"),
        ],
    ),
    Rule(
        "CRED009", CATEGORY, INFO, REMINDER,
        match=[
            rx(r"git\s+filter-(?:repo|branch)|\bgitleaks\b|\btrufflehog\b", "i"),
        ],
    ),
]
