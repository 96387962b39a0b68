"""Rules as rows of a table, or as plain dictionaries, for users who keep their own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .model import ADVISORY, CODE, REMINDER, Pattern, Rule, Rx

_PATTERNS = "array<struct<kind:string,pattern:string,flags:string>>"
SCHEMA = (
    f"code string, ordinal int, message string, severity int, category string, rule_type string, suggestion string, patterns {_PATTERNS},"
    f" context_aware boolean, negatives {_PATTERNS}, nearby {_PATTERNS}, include {_PATTERNS}, exclude {_PATTERNS}, reduce_in {_PATTERNS}"
)
MOST_RULES = 20_000
_LISTS = {"match": "patterns", "unless": "negatives", "unless_near": "nearby", "only_paths": "include", "skip_paths": "exclude", "info_paths": "reduce_in"}


def _row_of(p: Pattern) -> dict[str, str]:
    return {"kind": "regex", "pattern": p.text, "flags": p.flags} if isinstance(p, Rx) else {"kind": "literal", "pattern": p, "flags": ""}


def _pattern_of(p: Mapping[str, Any] | str) -> Pattern:
    if isinstance(p, str):
        return p
    if (p.get("kind") or "regex") not in ("regex", "literal"):
        raise ValueError(f"a pattern is a regex or a literal, not {p['kind']!r}")
    flags = p.get("flags") or ""
    if set(flags) - {"i", "m"}:
        raise ValueError(f"flags of {p['pattern']!r} may hold i and m, not {flags!r}")
    return p["pattern"] if p.get("kind") == "literal" else Rx(p["pattern"], flags)


def rule_from(row: Mapping[str, Any]) -> Rule:
    """A rule from a dictionary with the columns of SCHEMA; all but code, category and patterns may be missing or null."""
    get = lambda name, default: default if row.get(name) is None else row[name]
    kind, severity = get("rule_type", CODE), get("severity", 1)
    if kind not in (CODE, REMINDER, ADVISORY) or severity not in (0, 1, 2) or not get("patterns", ()):
        raise ValueError(f"rule {row.get('code')!r} needs patterns, a severity of 0 to 2 and a known type")
    lists = {own: [_pattern_of(p) for p in get(column, ())] for own, column in _LISTS.items()}
    return Rule(row["code"], row["category"], severity, kind, code_only=get("context_aware", False), message=get("message", row["code"]), suggestion=get("suggestion", ""), **lists)


def rule_rows(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """A row for each rule."""
    rows = [
        {"code": r.code, "ordinal": i, "message": r.message, "severity": r.severity, "category": r.category, "rule_type": r.kind, "suggestion": r.suggestion, "context_aware": r.code_only}
        | {column: [_row_of(p) for p in getattr(r, own)] for own, column in _LISTS.items()}
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def rules_of(table: DataFrame) -> list[Rule]:
    """The rules of a table, in the order of `ordinal` and code. They become part of the plan, so a table may hold MOST_RULES at most."""
    rows = table.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    given = [r.asDict(recursive=True) for r in rows]
    return [rule_from(r) for r in sorted(given, key=lambda r: (r.get("ordinal") is None, r.get("ordinal") or 0, r["code"]))]
