"""JSON web token verification."""

from .model import CODE, ERROR, INFO, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "JWT001", "auth-access-control", ERROR, CODE,
        match=[
            rx(r"""\balgorithms?\s*:\s*\[[^\]]*['"]none['"]""", "i"),
            rx(r"""\balg\s*:\s*['"]none['"]""", "i"),
            rx(r"""\bsetAllowedAlgorithms\s*\([^)]*['"]none['"]""", "i"),
            rx(r"""\balgorithms\s*=\s*\[[^\]]*['"]none['"]""", "i"),
        ],
    ),
    Rule(
        "JWT002", "auth-access-control", ERROR, CODE,
        match=[
            rx(r"""\bjwt\.verify\s*\(\s*\w[\w.]*\s*,\s*(?:\w[\w.]*|['"][^'"]+['"])\s*(?:,\s*\{[^}]{0,200}\}\s*)?\)"""),
        ],
        unless=[
            rx(r"algorithms?\s*:\s*\["),
            rx(r"\.requireAlgorithm\s*\("),
        ],
        unless_near=[
            rx(r"algorithms?\s*:\s*\["),
            rx(r"\.requireAlgorithm\s*\("),
        ],
    ),
    Rule(
        "JWT003", "auth-access-control", ERROR, CODE,
        match=[
            rx(r"\bjwt\.decode\s*\(\s*\w"),
            rx(r"\bjsonwebtoken\.decode\s*\(\s*\w"),
        ],
        unless_near=[
            rx(r"decode\s*\([^)]*,\s*\{[^}]*complete\s*:\s*true"),
            rx(r"\.header"),
        ],
    ),
    Rule(
        "JWT004", "auth-access-control", ERROR, CODE,
        match=[
            rx(r"\bjwt\.decode\s*\(\s*\w[\w.]*\s*,\s*\w[\w.]*\s*\)"),
        ],
        unless=[
            rx(r"algorithms\s*=\s*\["),
        ],
    ),
    Rule(
        "JWT005", "auth-access-control", ERROR, CODE,
        match=[
            rx(r"\bJwts\.parser(?:Builder)?\s*\(\s*\)\s*\.setSigningKey\s*\("),
        ],
        unless_near=[
            rx(r"\.requireAlgorithm\s*\("),
            rx(r"\.setAllowedClockSkewSeconds\s*\("),
        ],
    ),
    Rule(
        "JWT006", "auth-access-control", WARNING, CODE,
        match=[
            rx(r"ignoreExpiration\s*:\s*true", "i"),
            rx(r"verify_exp\s*=\s*False", "i"),
            rx(r"verify_expiration\s*=\s*False", "i"),
            rx(r"setAllowedClockSkewSeconds\s*\(\s*(?:31536000|604800|3600000)"),
        ],
    ),
    Rule(
        "JWT007", "auth-access-control", INFO, CODE,
        match=[
            rx(r"\bjwt\.verify\s*\("),
            rx(r"\bjsonwebtoken\.verify\s*\("),
        ],
        unless_near=[
            rx(r"issuer\s*:"),
            rx(r"audience\s*:"),
            rx(r"requireIssuer"),
            rx(r"requireAudience"),
        ],
    ),
]
