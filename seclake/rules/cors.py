"""Cross-origin settings."""

from .model import CODE, ERROR, INFO, REMINDER, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "CORS001", "cors-configuration", ERROR, CODE,
        match=[
            rx(r"""Access-Control-Allow-Origin['":\s]*['"]\*['"]""", "i"),
            rx(r"""origin\s*:\s*['"]\*['"]""", "i"),
            rx(r"cors\(\s*\)"),
        ],
    ),
    Rule(
        "CORS002", "cors-configuration", WARNING, REMINDER,
        match=[
            rx(r"credentials\s*:\s*true", "i"),
        ],
    ),
    Rule(
        "CORS003", "cors-configuration", ERROR, CODE,
        match=[
            rx(r"Access-Control-Allow-Origin.*req\.header", "i"),
            rx(r"Access-Control-Allow-Origin.*request\.headers", "i"),
        ],
    ),
    Rule(
        "CORS004", "cors-configuration", WARNING, CODE,
        match=[
            rx(r"""Access-Control-Allow-Methods['":\s]*['"].*\*.*['"]""", "i"),
        ],
    ),
    Rule(
        "CORS005", "cors-configuration", INFO, REMINDER,
        match=[
            rx(r"Access-Control-Allow-Headers", "i"),
        ],
    ),
    Rule(
        "CORS006", "cors-configuration", WARNING, CODE,
        match=[
            rx(r"maxAge\s*:\s*\d{6,}"),
            rx(r"""Access-Control-Max-Age['":\s]*['"]?\d{6,}""", "i"),
        ],
    ),
]
