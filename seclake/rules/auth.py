"""Login, session and token handling."""

from .model import CODE, ERROR, INFO, REMINDER, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "AUTH001", "auth-access-control", ERROR, CODE,
        match=[
            rx(r"""jwt\.sign\s*\([^,]+,\s*['"][^'"]{1,}['"]""", "i"),
            rx(r"""jsonwebtoken.*secret\s*[:=]\s*['"][^'"]+['"]""", "i"),
        ],
    ),
    Rule(
        "AUTH002", "auth-access-control", WARNING, CODE,
        match=[
            rx(r"httpOnly\s*:\s*false", "i"),
            rx(r"secure\s*:\s*false", "i"),
        ],
    ),
    Rule(
        "AUTH003", "auth-access-control", ERROR, CODE,
        match=[
            rx(r"password\s*===?\s*(?:req\.|request\.|body\.|params\.|input)", "i"),
            rx(r"(?:req\.|request\.|body\.)password\s*===?\s*", "i"),
        ],
    ),
    Rule(
        "AUTH004", "auth-access-control", WARNING, CODE,
        match=[
            rx(r"isAdmin\s*[:=]\s*true", "i"),
            rx(r"skipAuth\s*[:=]\s*true", "i"),
        ],
    ),
    Rule(
        "AUTH005", "auth-access-control", WARNING, CODE,
        match=[
            rx(r"password\.length\s*>=?\s*[1-5]\b", "i"),
            rx(r"minlength\s*[:=]\s*[1-5]\b", "i"),
            rx(r"min_length\s*[:=]\s*[1-5]\b", "i"),
        ],
    ),
    Rule(
        "AUTH006", "auth-access-control", INFO, REMINDER,
        match=[
            rx(r"/login|/signin|/authenticate|/auth/", "i"),
        ],
    ),
    Rule(
        "AUTH007", "auth-access-control", WARNING, CODE,
        match=[
            rx(r"""localStorage\.setItem\s*\(\s*['"](?:token|jwt|auth|session|access_token)['"]""", "i"),
        ],
    ),
]
