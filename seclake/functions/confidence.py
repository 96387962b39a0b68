"""How sure is a finding? critical, verify-needed, safe, or null when nothing is known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .paths import SOURCE_PATHS, TEST_PATHS

MIN_ACTIONS = 5
HIGH_FP = 0.7
HIGH_FIX = 0.8

# Shapes of literals, environment reads, joins, templates and parameters.
_LITERAL = r"""=\s*['"`][^'"`]{2,}['"`]"""
_ENVIRONMENT = r"(?i)process\.env|os\.environ|getenv|env\[|ENV\["
_ASSIGNED = r"=\s*\w+"
_JOINED = r"""['"`]\s*\+|\+\s*['"`]"""
_TEMPLATE = r"\$\{"
_PARAMETER = r"\?\s*[,)]|\$\d+|:\w+"
_STATIC = r"""=\s*['"`][^+$]*['"`]\s*[;,]?\s*$"""


def is_secret(code: Column) -> Column:
    return code.startswith("CRED") | code.startswith("AUTH001")


#: How the codes begin whose confidence depends on the lines around, too.
QUERY_CODES = ("SQL", "DB001", "DB002")


def is_query(code: Column) -> Column:
    return reduce(Column.__or__, [code.startswith(c) for c in QUERY_CODES])


def static_confidence(code: Column, text: Column, around: Column) -> Column:
    """`around` holds the two lines before and after, without the line itself. It matters for `QUERY_CODES` only."""
    line = F.trim(text)
    secret = (
        F.when(line.rlike(_LITERAL), F.when(line.rlike(_ENVIRONMENT), "verify-needed").otherwise("critical"))
        .when(line.rlike(_ASSIGNED), "verify-needed")
    )
    query = (
        F.when(line.rlike(_JOINED) | line.rlike(_TEMPLATE), "verify-needed")
        .when(line.rlike(_PARAMETER) | line.rlike(_STATIC), "safe")
        .when(F.exists(around, lambda l: l.rlike(_JOINED) | l.rlike(_TEMPLATE)), "verify-needed")
    )
    return F.when(is_secret(code), secret).when(is_query(code), query)


def lowered(level: Column) -> Column:
    return F.when(level == "critical", "verify-needed").when(level == "verify-needed", "safe").otherwise(level)


def raised(level: Column) -> Column:
    return (
        F.when(level == "safe", "verify-needed").when(level == "verify-needed", "critical")
        .when(level.isNull(), "verify-needed").otherwise(level)
    )


def adaptive_confidence(level: Column, path: Column, stats: dict[str, Column]) -> Column:
    """Shift a level by what users did with the rule before.

    `stats` holds fps, fixed, verified, ignored of the rule and lang_fps, lang_fixed of the language.
    """
    fps, fixed, verified = stats["fps"], stats["fixed"], stats["verified"]
    actions = fps + fixed + verified + stats["ignored"]
    actionable = fps + fixed + verified
    fp_rate = F.when(actionable > 0, fps / actionable).otherwise(0.0)
    lang = stats["lang_fixed"] + stats["lang_fps"]
    trusted = path.rlike(SOURCE_PATHS) & (lang >= 3) & (stats["lang_fixed"] / lang >= HIGH_FIX)
    steps = [
        lambda l: F.when(fp_rate >= HIGH_FP, lowered(l)).otherwise(l),
        lambda l: F.when((fixed + verified) / actions >= HIGH_FIX, raised(l)).otherwise(l),
        lambda l: F.when(path.rlike(TEST_PATHS), lowered(l)).otherwise(l),
        lambda l: F.when(F.coalesce(trusted, F.lit(False)), raised(l)).otherwise(l),
    ]
    # Each step names the level several times; bound to a name it is one value, not a copy of all steps before.
    shifted = reduce(let, steps, level)
    return F.when(F.coalesce(actions, F.lit(0)) >= MIN_ACTIONS, shifted).otherwise(level)
