"""Debug switches, source maps, image secrets."""

from .model import ADVISORY, CODE, ERROR, INFO, REMINDER, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "INFRA001", "infrastructure-deployment", INFO, REMINDER,
        match=[
            rx(r"NODE_ENV"),
            rx(r"RAILS_ENV"),
            rx(r"DJANGO_SETTINGS", "i"),
            rx(r"APP_ENV"),
        ],
    ),
    Rule(
        "INFRA002", "infrastructure-deployment", WARNING, CODE,
        match=[
            rx(r"""DEBUG\s*[:=]\s*(?:true|1|['"]on['"])""", "i"),
            rx(r"FLASK_DEBUG\s*[:=]\s*(?:true|1)", "i"),
            rx(r"APP_DEBUG\s*[:=]\s*(?:true|1)", "i"),
        ],
    ),
    Rule(
        "INFRA003", "infrastructure-deployment", WARNING, CODE,
        match=[
            rx(r"""level\s*[:=]\s*['"](?:debug|trace|verbose)['"]""", "i"),
            rx(r"""LOG_LEVEL\s*[:=]\s*['"](?:debug|trace|verbose)['"]""", "i"),
            rx(r"logging\.(?:DEBUG|TRACE)"),
        ],
    ),
    Rule(
        "INFRA004", "infrastructure-deployment", WARNING, CODE,
        match=[
            rx(r"showStackTrace\s*[:=]\s*true", "i"),
            rx(r"SHOW_ERRORS\s*[:=]\s*(?:true|1)", "i"),
            rx(r"fullError\s*[:=]\s*true", "i"),
            rx(r"displayErrors\s*[:=]\s*(?:true|1)", "i"),
        ],
    ),
    Rule(
        "INFRA005", "infrastructure-deployment", ERROR, CODE,
        match=[
            rx(r"(?:ENV|ARG)\s+\w*(?:SECRET|PASSWORD|KEY|TOKEN)\w*", "i"),
            rx(r"COPY\s+.*\.env", "i"),
            rx(r"COPY\s+.*credentials", "i"),
        ],
    ),
    Rule(
        "INFRA006", "infrastructure-deployment", WARNING, ADVISORY,
        match=[
            rx(r"echo\s+.*\$\{?\w*(?:SECRET|PASSWORD|KEY|TOKEN)", "i"),
            rx(r"printenv", "i"),
        ],
    ),
    Rule(
        "INFRA007", "infrastructure-deployment", WARNING, CODE,
        match=[
            rx(r"sourceMappingURL"),
            rx(r"""devtool\s*:\s*['"].*source-map['"]""", "i"),
            rx(r"sourceMap\s*[:=]\s*true", "i"),
            rx(r"generate_source_map\s*[:=]\s*true", "i"),
        ],
    ),
    Rule(
        "INFRA008", "infrastructure-deployment", WARNING, CODE,
        match=[
            rx(r"(?:test|seed|mock)(?:_|-)?data", "i"),
            rx(r"faker\.", "i"),
            rx(r"(?:test|seed)(?:_|-)?fixture", "i"),
        ],
    ),
]
