"""Container build files."""

from .model import CODE, ERROR, INFO, REMINDER, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.
DOCKERFILES_ONLY = [
    rx(r"(^|[\\/])(?:Dockerfile|Containerfile|dockerfile)(?:\..*)?$", "i"),
    rx(r"\.dockerfile$", "i"),
]

RULES = [
    Rule(
        "DOCKER001", "infrastructure-deployment", WARNING, CODE,
        match=[
            rx(r"^\s*FROM\s+[\w./\-]+(?::latest)?\s*$", "i"),
            rx(r"^\s*FROM\s+[\w./\-]+:latest(?:\s+AS\s+\w+)?\s*$", "i"),
        ],
        unless=[
            rx(r"^\s*FROM\s+scratch\b", "i"),
        ],
        only_paths=DOCKERFILES_ONLY,
    ),
    Rule(
        "DOCKER002", "infrastructure-deployment", WARNING, REMINDER,
        match=[
            rx(r"^\s*FROM\s+", "i"),
        ],
        unless_near=[
            rx(r"^\s*USER\s+(?!root\b|0\b)", "im"),
        ],
        only_paths=DOCKERFILES_ONLY,
    ),
    Rule(
        "DOCKER003", "infrastructure-deployment", ERROR, CODE,
        match=[
            rx(r"""^\s*ENV\s+\w*(?:PASSWORD|SECRET|TOKEN|API_?KEY|PRIVATE_?KEY)\s*[=\s]\s*(?!["']?\$\{?)\S{6,}""", "i"),
            rx(r"""^\s*ARG\s+\w*(?:PASSWORD|SECRET|TOKEN|API_?KEY)\s*=\s*(?!["']?\$\{?)\S{6,}""", "i"),
            rx(r"""^\s*RUN\s+echo\s+["']?\w*(?:PASSWORD|SECRET|TOKEN|API_?KEY)\b[^>]*>""", "i"),
        ],
        only_paths=DOCKERFILES_ONLY,
    ),
    Rule(
        "DOCKER004", "infrastructure-deployment", WARNING, CODE,
        match=[
            rx(r"^\s*ADD\s+https?://", "i"),
        ],
        only_paths=DOCKERFILES_ONLY,
    ),
    Rule(
        "DOCKER005", "infrastructure-deployment", INFO, CODE,
        match=[
            rx(r"^\s*ADD\s+(?!https?://|--chown=|--checksum=)[^\s]+\s+[^\s]+\s*$", "i"),
        ],
        only_paths=DOCKERFILES_ONLY,
    ),
    Rule(
        "DOCKER006", "infrastructure-deployment", INFO, CODE,
        match=[
            rx(r"^\s*RUN\s+apt-get\s+install\b(?!.*--no-install-recommends)", "i"),
            rx(r"^\s*RUN\s+apk\s+add\b(?!.*--no-cache)", "i"),
        ],
        only_paths=DOCKERFILES_ONLY,
    ),
    Rule(
        "DOCKER007", "infrastructure-deployment", ERROR, CODE,
        match=[
            rx(r"^\s*RUN\s+.*\b(?:curl|wget)[^|]+\|\s*(?:bash|sh|zsh|ksh)\b", "i"),
            rx(r"^\s*RUN\s+.*\b(?:curl|wget)[^|]+\|\s*su\s+-", "i"),
        ],
        only_paths=DOCKERFILES_ONLY,
    ),
    Rule(
        "DOCKER008", "infrastructure-deployment", INFO, CODE,
        match=[
            rx(r"^\s*HEALTHCHECK\s+NONE\b", "i"),
        ],
        only_paths=DOCKERFILES_ONLY,
    ),
]
