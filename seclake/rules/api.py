"""Endpoints, limits and error details."""

from .model import CODE, INFO, REMINDER, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "API001", "api-security", WARNING, REMINDER,
        match=[
            rx(r"""app\.(?:get|post|put|delete|patch)\s*\(\s*['"]/api/""", "i"),
            rx(r"""router\.(?:get|post|put|delete|patch)\s*\(\s*['"]/api/""", "i"),
        ],
    ),
    Rule(
        "API002", "api-security", WARNING, CODE,
        match=[
            rx(r"introspection\s*:\s*true", "i"),
        ],
    ),
    Rule(
        "API003", "api-security", INFO, REMINDER,
        match=[
            rx(r"""app\.use\s*\(\s*['"]/api""", "i"),
        ],
    ),
    Rule(
        "API004", "api-security", WARNING, CODE,
        match=[
            rx(r"res\.(?:json|send)\s*\(.*(?:stack|stackTrace)", "i"),
            rx(r"\.status\s*\(\s*500\s*\)\.(?:json|send)\s*\(\s*(?:err|error)\s*\)", "i"),
        ],
    ),
    Rule(
        "API005", "api-security", WARNING, CODE,
        match=[
            rx(r"express\.json\s*\(\s*\)"),
            rx(r"bodyParser\.json\s*\(\s*\)"),
        ],
    ),
    Rule(
        "API006", "api-security", WARNING, CODE,
        match=[
            rx(r"""DEBUG\s*[:=]\s*(?:true|1|['"]true['"])""", "i"),
            rx(r"app\.debug\s*=\s*True", "i"),
            rx(r"FLASK_DEBUG\s*[:=]\s*1", "i"),
        ],
    ),
    Rule(
        "API007", "api-security", WARNING, CODE,
        match=[
            rx(r"(?:err|error)\.stack", "i"),
        ],
    ),
    Rule(
        "API008", "api-security", INFO, REMINDER,
        match=[
            rx(r"api[_-]?key", "i"),
            rx(r"apiToken", "i"),
            rx(r"x-api-key", "i"),
        ],
    ),
    Rule(
        "API009", "api-security", INFO, REMINDER,
        match=[
            rx(r"(?:generate|create|issue).*(?:api[_-]?key|token)", "i"),
            rx(r"(?:api[_-]?key|token).*(?:generate|create|issue)", "i"),
        ],
    ),
    Rule(
        "API010", "api-security", WARNING, REMINDER,
        match=[
            rx(r"(?:params|query)\.(?:id|userId|user_id|accountId|account_id)\b", "i"),
            rx(r"findById\s*\(\s*(?:req|request)\.", "i"),
            rx(r"findOne\s*\(\s*\{\s*(?:_id|id)\s*:\s*(?:req|request)\.", "i"),
        ],
    ),
    Rule(
        "API011", "api-security", WARNING, CODE,
        match=[
            rx(r"""role\s*[:=]\s*['"]\*['"]""", "i"),
            rx(r"""permissions?\s*[:=]\s*\[\s*['"]\*['"]\s*\]""", "i"),
            rx(r"""scope\s*[:=]\s*['"]\*['"]""", "i"),
            rx(r"""allow\s*[:=]\s*['"]\*['"]""", "i"),
        ],
    ),
    Rule(
        "API012", "api-security", INFO, REMINDER,
        match=[
            rx(r"rateLimit", "i"),
            rx(r"rateLimiter", "i"),
            rx(r"express-rate-limit", "i"),
        ],
    ),
    Rule(
        "API013", "api-security", INFO, REMINDER,
        match=[
            rx(r"windowMs", "i"),
            rx(r"max\s*:\s*\d+.*(?:request|req)", "i"),
        ],
    ),
    Rule(
        "API014", "api-security", INFO, REMINDER,
        match=[
            rx(r"app\.listen\s*\(", "i"),
            rx(r"createServer\s*\(", "i"),
        ],
    ),
    Rule(
        "API015", "api-security", WARNING, REMINDER,
        match=[
            rx(r"x-powered-by", "i"),
            rx(r"""Server\s*:\s*['"](?:Express|Apache|nginx|IIS)""", "i"),
        ],
        unless=[
            rx(r"removeHeader", "i"),
            rx(r"hidePoweredBy", "i"),
            rx(r"""disable\s*\(\s*['"]x-powered-by""", "i"),
        ],
    ),
    Rule(
        "API016", "api-security", INFO, REMINDER,
        match=[
            rx(r"app\.listen\s*\(", "i"),
            rx(r"createServer\s*\(", "i"),
        ],
        unless_near=[
            rx(r"helmet\s*\(", "i"),
            rx(r"helmet\(\)", "i"),
            rx(r"""require\s*\(\s*['"]helmet['"]\)""", "i"),
            rx(r"""from\s+['"]helmet['"]""", "i"),
        ],
        only_paths=[
            rx(r"\.(?:js|ts|mjs|cjs)$", "i"),
        ],
    ),
]
