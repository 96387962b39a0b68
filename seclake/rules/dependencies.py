"""Dependency pinning."""

from .model import ADVISORY, CODE, INFO, REMINDER, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "DEP001", "dependencies-supply-chain", WARNING, CODE,
        match=[
            rx(r"""["']\^[0-9]+\."""),
            rx(r"""["']~[0-9]+\."""),
            rx(r"""["']\*["']"""),
            rx(r"""["']>=\s*[0-9]+\."""),
            rx(r"""["']latest["']"""),
        ],
    ),
    Rule(
        "DEP002", "dependencies-supply-chain", INFO, REMINDER,
        match=[
            rx(r"""["']dependencies["']\s*:"""),
            rx(r"""["']devDependencies["']\s*:"""),
            rx(r"require\s*\("),
        ],
    ),
    Rule(
        "DEP003", "dependencies-supply-chain", INFO, ADVISORY,
        match=[
            rx(r"""["']dependencies["']\s*:"""),
            rx(r"require\s*\("),
            rx(r"""from\s+["'][a-z@]"""),
        ],
    ),
    Rule(
        "DEP004", "dependencies-supply-chain", INFO, ADVISORY,
        match=[
            rx(r"""["']dependencies["']\s*:"""),
            rx(r"require\s*\("),
            rx(r"""from\s+["'][a-z@]"""),
        ],
    ),
    Rule(
        "DEP005", "dependencies-supply-chain", INFO, ADVISORY,
        match=[
            rx(r"""["']dependencies["']\s*:"""),
            rx(r"require\s*\("),
            rx(r"""from\s+["'][a-z@]"""),
        ],
    ),
    Rule(
        "DEP006", "dependencies-supply-chain", INFO, ADVISORY,
        match=[
            rx(r"""["']dependencies["']\s*:"""),
            rx(r"require\s*\("),
            rx(r"""from\s+["'][a-z@]"""),
        ],
    ),
]
