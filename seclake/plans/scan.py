"""Whole scans: from files to findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import QUERY_CODES, adaptive_confidence, static_confidence
from ..operators.learning import language_stats, rule_stats
from ..operators.matching import FILE, FINDING, line_findings, pick_reminders, scan_rules
from ..operators.suppression import helpers_nearby, internal_paths, learned_suppression, without_dismissed, without_ignored, without_info
from ..operators.taint import flow_analysis
from ..rules import Rule, all_rules
from ..sources.files import NO_LIMITS, Limits, scannable


def enabled_rules(
    rules: Sequence[Rule] | None = None, categories: Sequence[str] | None = None, codes: Sequence[str] | None = None
) -> list[Rule]:
    """Rules chosen before the plan is built: categories and codes never reach the data."""
    kept = list(rules) if rules is not None else all_rules()
    if categories:
        kept = [r for r in kept if r.category in categories]
    if codes:
        kept = [r for r in kept if r.code in codes]
    return kept


def scan(
    files: DataFrame, rules: Sequence[Rule] | None = None, taint: bool = True, limits: Limits = NO_LIMITS,
    languages: Sequence[str] | None = None, repos: Sequence[str] | None = None, paths: str | None = None,
) -> DataFrame:
    """The whole scan: all rules and taint, on everything unless `limits` leaves something out.

    `languages`, `repos` and `paths` (a pattern) are tested before any text is read, so that they reach the scan of a stored
    table. What the limits leave out is told by `sources.files.skipped`.
    """
    chosen = enabled_rules(rules)
    kept = files.select(*FILE, "content")
    if repos:
        kept = kept.where(F.col("repo").isin(list(repos)))
    if languages:
        kept = kept.where(F.col("language").isin(list(languages)))
    if paths:
        kept = kept.where(F.col("path").rlike(paths))
    if limits.file_bytes or limits.skip_generated or limits.skip_minified:
        kept = kept.where(scannable(F.col("path"), F.col("content"), limits))
    return scan_rules(kept, chosen, limits.reminder_lines, line_limit=limits.line_chars, companion=flow_analysis(limits) if taint else None)


def two_lines_around(near: Column, line: Column) -> Column:
    """Of the lines within three, the two before and the two after."""
    at = F.least(line, F.lit(3))
    return F.concat(F.slice(near, F.greatest(at - 1, F.lit(1)), F.least(at, F.lit(2))), F.slice(near, at + 2, 2))


def findings_with_confidence(
    files: DataFrame, rules: Sequence[Rule] | None = None, markup: bool = True, limits: Limits = NO_LIMITS, safe: DataFrame | None = None,
) -> DataFrame:
    """Findings as an editor sees them: markup text counts as text, and each finding has a confidence.

    The confidence is told where the text is, so that no line is moved; lines around go only with the hits that need them. With learned
    helpers, which may be around any hit, `covered` tells whether one is nearby.
    """
    chosen = enabled_rules(rules)

    def judge(hits: DataFrame) -> DataFrame:
        level = static_confidence(F.col("code"), F.col("text"), two_lines_around(F.col("near"), F.col("line")))
        told = hits.withColumn("confidence", level)
        return told if safe is None else helpers_nearby(told, safe, [r.code for r in chosen])

    near = QUERY_CODES if safe is None else True
    found = pick_reminders(line_findings(files, chosen, near, markup, limits.line_chars, judge=judge), limits.reminder_lines)
    return found.select(*FINDING, "confidence", *(["covered"] if safe is not None else []))


def with_adaptive_confidence(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """Confidence shifted by past actions on the rule and its language."""
    stats = rule_stats(actions).select("code", "fps", "fixed", "verified", "ignored")
    langs = language_stats(actions).select("code", "language", "lang_fps", "lang_fixed")
    joined = findings.join(stats, "code", "left").join(langs, ["code", "language"], "left")
    columns = {k: F.col(k) for k in ("fps", "fixed", "verified", "ignored", "lang_fps", "lang_fixed")}
    level = adaptive_confidence(F.col("confidence"), F.col("path"), columns)
    return joined.withColumn("confidence", level).select(*findings.columns)


def editor_scan(
    files: DataFrame, rules: Sequence[Rule] | None = None, ignores: DataFrame | None = None,
    dismissals: DataFrame | None = None, hashes: DataFrame | None = None, safe: DataFrame | None = None,
    actions: DataFrame | None = None, show_info: bool = True, reduce_internal: bool = False, limits: Limits = NO_LIMITS,
) -> DataFrame:
    """The editor's scan: confidence, learned helpers, ignores, dismissals, information and path rules."""
    found = findings_with_confidence(files, rules, limits=limits, safe=safe)
    if safe is not None:
        found = learned_suppression(found)
    if actions is not None:
        found = with_adaptive_confidence(found, actions)
    if ignores is not None:
        found = without_ignored(found, ignores)
    if dismissals is not None and hashes is not None:
        found = without_dismissed(found, dismissals, hashes)
    if not show_info:
        found = without_info(found)
    return (internal_paths(found) if reduce_internal else found).select(*FINDING, "confidence")
