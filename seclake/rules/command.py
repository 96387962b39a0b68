"""Shell commands built from input."""

from .model import CODE, ERROR, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "CMD001", "api-security", ERROR, CODE,
        match=[
            rx(r"""\b(?:child_process\.)?exec(?:Sync)?\s*\(\s*['"`][^'"`]*['"`]\s*\+\s*(?:req|request|ctx)\.(?:query|body|params|headers)"""),
            rx(r"\b(?:child_process\.)?exec(?:Sync)?\s*\(\s*\`[^\`]*\$\{\s*(?:req|request|ctx)\.(?:query|body|params|headers)"),
        ],
    ),
    Rule(
        "CMD002", "api-security", ERROR, CODE,
        match=[
            rx(r"\bspawn(?:Sync)?\s*\([^)]+,\s*[^)]+,\s*\{[^}]*shell\s*:\s*true"),
        ],
    ),
    Rule(
        "CMD003", "api-security", ERROR, CODE,
        match=[
            rx(r"""\bos\.(?:system|popen)\s*\(\s*['"`][^'"`]*['"`]\s*\+\s*(?:request\.|sys\.argv|user_input)"""),
            rx(r"""\bos\.(?:system|popen)\s*\(\s*f['"][^'"]*\{(?:request\.|sys\.argv|user_input)"""),
        ],
    ),
    Rule(
        "CMD004", "api-security", ERROR, CODE,
        match=[
            rx(r"\bsubprocess\.(?:run|call|check_call|check_output|Popen)\s*\([^)]*shell\s*=\s*True"),
        ],
        unless_near=[
            rx(r"shlex\.quote"),
            rx(r"shlex\.split"),
        ],
    ),
    Rule(
        "CMD005", "api-security", ERROR, CODE,
        match=[
            rx(r"\b(?:shell_exec|passthru|system|exec|proc_open|popen)\s*\(\s*[^)]*\$_(?:GET|POST|REQUEST|COOKIE)"),
        ],
    ),
    Rule(
        "CMD006", "api-security", ERROR, CODE,
        match=[
            rx(r"""\bsystem\s*\(\s*['"][^'"]*#\{(?:params|request|cookies)"""),
            rx(r"`[^`]*#\{(?:params|request|cookies)"),
            rx(r"""\bIO\.popen\s*\(\s*['"][^'"]*#\{(?:params|request|cookies)"""),
        ],
    ),
    Rule(
        "CMD007", "api-security", ERROR, CODE,
        match=[
            rx(r"""\bRuntime\.getRuntime\s*\(\s*\)\s*\.exec\s*\(\s*['"][^'"]*['"]\s*\+\s*request\."""),
            rx(r"""\bnew\s+ProcessBuilder\s*\(\s*['"][^'"]*['"]\s*\+\s*request\."""),
        ],
    ),
]
