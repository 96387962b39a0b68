"""Secrets in lines that commits added, whether or not they are still there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefilter import candidate_number, line_candidates
from ..rules import Rule, history_rules
from ..sources.changes import added_lines
from .matching import by_pattern, pattern_table
from .statistics import severity_label


def history_findings(patches: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per (rule, added line): commit, place and match. No context filter applies to history."""
    rules = list(rules) if rules is not None else history_rules()
    patterns = [p for r in rules for p in r.match]
    lines = added_lines(patches.select("repo", "sha", "author", "committed_at", "patch"))
    marked = lines.withColumn("numbers", line_candidates(F.col("text"), patterns))
    pairs = marked.where(F.size("numbers") > 0).select(
        "repo", "sha", "author", "committed_at", "path", "line", "text", F.explode(F.transform("numbers", candidate_number)).alias("number")
    )
    table = pattern_table(patches.sparkSession, rules).select("number", "code", "message", "severity", "regex", "unless", "literal")
    hits = by_pattern(pairs).join(F.broadcast(table), "number").where(
        F.rlike("text", F.col("regex")) & ~F.coalesce(F.rlike("text", F.col("unless")), F.lit(False))
    )
    hits = hits.withColumn("match", F.coalesce("literal", F.regexp_substr("text", F.col("regex"))))
    first = hits.groupBy("repo", "sha", "author", "committed_at", "path", "line", "code").agg(
        F.min(F.struct("number", "severity", "message", "match")).alias("h")
    )
    return first.select(
        "repo", "sha", "author", "committed_at", "path", "line", "code", F.col("h.message").alias("message"),
        severity_label(F.col("h.severity")).alias("severity"), F.col("h.match").alias("match"),
    )


def masked(match: Column, width: int = 80) -> Column:
    """Long matches are cut for display."""
    return F.when(F.length(match) > width, F.concat(F.substring(match, 1, width - 3), F.lit("..."))).otherwise(match)


def history_by_commit(findings: DataFrame) -> DataFrame:
    """(repo, sha, author, committed_at, n, rules, files): findings counted per commit.

    Counts are taken per (commit, rule, file) first, so that a huge commit spreads over its files.
    """
    per = findings.groupBy("repo", "sha", "author", "committed_at", "code", "path").agg(F.count("*").alias("n"))
    return per.groupBy("repo", "sha", "author", "committed_at").agg(
        F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_set("code")), ",").alias("rules"),
        F.countDistinct("path").alias("files"),
    )
