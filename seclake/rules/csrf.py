"""Cross-site request forgery."""

from .model import CODE, ERROR, INFO, REMINDER, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "CSRF001", "csrf-protection", WARNING, REMINDER,
        match=[
            rx(r"""<form\s[^>]*method\s*=\s*['"]post['"][^>]*>""", "i"),
        ],
    ),
    Rule(
        "CSRF002", "csrf-protection", ERROR, CODE,
        match=[
            rx(r"csrf\s*[:=]\s*false", "i"),
            rx(r"csrfProtection\s*[:=]\s*false", "i"),
            rx(r"@csrf_exempt", "i"),
            rx(r"csrf_exempt", "i"),
        ],
    ),
    Rule(
        "CSRF003", "csrf-protection", WARNING, CODE,
        match=[
            rx(r"""sameSite\s*:\s*['"]none['"]""", "i"),
        ],
    ),
    Rule(
        "CSRF004", "csrf-protection", WARNING, CODE,
        match=[
            rx(r"app\.get\s*\(.*(?:delete|remove|update|create|modify)", "i"),
            rx(r"router\.get\s*\(.*(?:delete|remove|update|create|modify)", "i"),
        ],
    ),
    Rule(
        "CSRF005", "csrf-protection", INFO, REMINDER,
        match=[
            rx(r"app\.(?:post|put|patch|delete)\s*\(", "i"),
            rx(r"router\.(?:post|put|patch|delete)\s*\(", "i"),
        ],
    ),
    Rule(
        "CSRF006", "csrf-protection", WARNING, CODE,
        match=[
            rx(r"csrf.*Math\.random", "i"),
            rx(r"token.*Math\.random", "i"),
            rx(r"Math\.random.*csrf", "i"),
            rx(r"Math\.random.*token", "i"),
        ],
    ),
    Rule(
        "CSRF007", "csrf-protection", INFO, REMINDER,
        match=[
            rx(r"csrfToken", "i"),
            rx(r"csrf_token", "i"),
            rx(r"_csrf", "i"),
        ],
    ),
    Rule(
        "CSRF008", "csrf-protection", INFO, REMINDER,
        match=[
            rx(r"res\.cookie\s*\(", "i"),
            rx(r"setCookie\s*\(", "i"),
        ],
        unless_near=[
            rx(r"csrf", "i"),
            rx(r"xsrf", "i"),
            rx(r"double.?submit", "i"),
            rx(r"csrfToken", "i"),
        ],
    ),
    Rule(
        "CSRF009", "csrf-protection", INFO, REMINDER,
        match=[
            rx(r"XMLHttpRequest", "i"),
            rx(r"""fetch\s*\(\s*['"`]""", "i"),
            rx(r"axios\.\w+\s*\(", "i"),
        ],
        unless_near=[
            rx(r"X-Requested-With", "i"),
            rx(r"csrf", "i"),
            rx(r"xsrf", "i"),
            rx(r"X-CSRF", "i"),
            rx(r"csrfToken", "i"),
        ],
    ),
]
