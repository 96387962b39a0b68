"""Query injection and database accounts."""

from .model import CODE, ERROR, INFO, REMINDER, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "DB001", "database-security", ERROR, CODE,
        match=[
            rx(r"""(?:\.query|\.exec|\.prepare|\.execute|\.raw)\s*\(\s*['"`].*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\b.*['"`]\s*\+""", "i"),
            rx(r"(?:\.query|\.exec|\.prepare|\.execute|\.raw)\s*\(\s*`.*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\b.*\$\{", "i"),
            rx(r"""['"`]\s*\+\s*(?:req|request|params|query|body)\.""", "i"),
            rx(r"""\.query\s*\(\s*['"`].*\+""", "i"),
        ],
        unless=[
            rx(r"confirm\s*\(", "i"),
            rx(r"alert\s*\(", "i"),
            rx(r"localStorage", "i"),
            rx(r"sessionStorage", "i"),
            rx(r"console\.\w+\s*\(", "i"),
            rx(r"window\.\w+", "i"),
        ],
        code_only=True,
    ),
    Rule(
        "DB002", "database-security", ERROR, CODE,
        match=[
            rx(r"\.find\s*\(\s*(?:req|request)\.(?:body|query|params)", "i"),
            rx(r"\.findOne\s*\(\s*(?:req|request)\.(?:body|query|params)", "i"),
            rx(r"\$where\s*:", "i"),
        ],
    ),
    Rule(
        "DB003", "database-security", ERROR, CODE,
        match=[
            rx(r"(?:mongodb|mysql|postgres|postgresql|mssql)://\w+:\w+@", "i"),
            rx(r"""connectionString\s*[:=]\s*['"].*(?:password|pwd)\s*=""", "i"),
        ],
    ),
    Rule(
        "DB004", "database-security", WARNING, CODE,
        match=[
            rx(r"""\.raw\s*\(\s*['"`].*\+""", "i"),
            rx(r"\.raw\s*\(\s*`.*\$\{", "i"),
            rx(r"Sequelize\.literal\s*\(", "i"),
            rx(r"""\.execute\s*\(\s*f['"].*\{""", "i"),
        ],
    ),
    Rule(
        "DB005", "database-security", ERROR, CODE,
        match=[
            rx(r"child_process.*exec\s*\(.*\+", "i"),
            rx(r"child_process.*exec\s*\(.*\$\{", "i"),
            rx(r"os\.system\s*\(.*\+", "i"),
            rx(r"subprocess\.call\s*\(.*shell\s*=\s*True", "i"),
        ],
    ),
    Rule(
        "DB006", "database-security", INFO, REMINDER,
        match=[
            rx(r"SELECT\s+\*\s+FROM", "i"),
        ],
    ),
    Rule(
        "DB007", "database-security", INFO, REMINDER,
        match=[
            rx(r"DROP\s+TABLE", "i"),
            rx(r"DROP\s+DATABASE", "i"),
            rx(r"TRUNCATE\s+TABLE", "i"),
        ],
    ),
    Rule(
        "DB008", "database-security", INFO, REMINDER,
        match=[
            rx(r"GRANT\s+ALL", "i"),
            rx(r"createConnection", "i"),
            rx(r"createPool", "i"),
            rx(r"mongoose\.connect", "i"),
        ],
    ),
    Rule(
        "DB009", "database-security", INFO, REMINDER,
        match=[
            rx(r"(?:backup|dump|restore).*(?:database|db|sql|mongo)", "i"),
            rx(r"(?:database|db|sql|mongo).*(?:backup|dump|restore)", "i"),
        ],
    ),
    Rule(
        "DB010", "database-security", INFO, REMINDER,
        match=[
            rx(r"\.query\s*\(", "i"),
            rx(r"\.execute\s*\(", "i"),
        ],
    ),
    Rule(
        "DB011", "database-security", ERROR, CODE,
        match=[
            rx(r"""(?:user|username)\s*[:=]\s*['"](?:root|admin|sa|postgres|mysql)['"]""", "i"),
            rx(r"""(?:password|passwd|pwd)\s*[:=]\s*['"](?:root|admin|password|123456)['"]""", "i"),
        ],
        unless=[
            rx(r"crypto\.randomBytes", "i"),
            rx(r"randomBytes", "i"),
            rx(r"generatePassword", "i"),
            rx(r"generateTempPassword", "i"),
            rx(r"randomPassword", "i"),
            rx(r"uuid", "i"),
        ],
    ),
    Rule(
        "DB012", "database-security", INFO, REMINDER,
        match=[
            rx(r"""(?:host|hostname)\s*[:=]\s*['"](?:0\.0\.0\.0|localhost|127\.0\.0\.1)['"]""", "i"),
        ],
    ),
    Rule(
        "DB013", "database-security", INFO, REMINDER,
        match=[
            rx(r"""\.query\s*\(\s*['"`]""", "i"),
            rx(r"""\.execute\s*\(\s*['"`]""", "i"),
        ],
        unless_near=[
            rx(r"\?\s*,", "i"),
            rx(r"\$\d"),
            rx(r":param", "i"),
            rx(r"parameterized", "i"),
            rx(r"prepared", "i"),
            rx(r"bindParam", "i"),
        ],
    ),
]
