"""Drop or lower findings: ignore lists, dismissals, baselines, learned helpers, paths, thresholds.

Joins by file carry no hint: sizes of these tables depend on users, so the planner decides at run time whether a side is small
enough to broadcast. Joins by rule, of which a few hold most findings, go through `joining.meet`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import INTERNAL_PATHS, normal_path
from ..rules.model import WARNING
from .joining import meet

KEY = ["repo", "path", "code", "line", "pattern"]


def without_ignored(findings: DataFrame, ignores: DataFrame, wildcard: bool = False) -> DataFrame:
    """Entries match a rule and a path exactly; an entry with a line (from 1) matches that line only."""
    e = ignores.select(
        F.col("repo").alias("i_repo"), F.col("code").alias("i_code"), F.col("path").alias("i_path"),
        F.col("line").alias("i_line"),
    ).distinct()
    same = (F.col("repo") == F.col("i_repo")) & (F.col("code") == F.col("i_code"))
    lines = F.col("i_line").isNull() | (F.col("i_line") == F.col("line") + 1)
    exact = e.where(F.col("i_path") != "*") if wildcard else e
    kept = findings.join(exact, same & (normal_path(F.col("path")) == F.col("i_path")) & lines, "left_anti")
    if wildcard:
        anywhere = ignores.where(F.col("path") == "*").select("repo", "code", "line").distinct()
        kept = meet(kept, anywhere, ["repo", "code"], "left_anti", lambda side: side("line").isNull() | (side("line") == F.col("line") + 1))
    return kept


def without_dismissed(findings: DataFrame, dismissals: DataFrame, hashes: DataFrame) -> DataFrame:
    """A dismissal holds while the file is what it was; without a known hash the finding returns."""
    valid = dismissals.join(
        hashes.select("repo", "path", F.col("content_hash").alias("now")), ["repo", "path"]
    ).where(F.col("now") == F.col("content_hash"))
    return findings.join(valid.select(*KEY).distinct(), KEY, "left_anti")


def outdated_dismissals(dismissals: DataFrame, hashes: DataFrame) -> DataFrame:
    """Dismissals to revoke because their file changed."""
    now = hashes.select(F.col("repo").alias("h_repo"), F.col("path").alias("h_path"), F.col("content_hash").alias("now"))
    changed = (
        (F.col("repo") == F.col("h_repo")) & (F.col("path") == F.col("h_path")) & (F.col("content_hash") != F.col("now"))
    )
    return dismissals.join(now, changed, "left_semi")


def build_baseline(findings: DataFrame) -> DataFrame:
    return (
        findings.groupBy("repo", normal_path(F.col("path")).alias("path"), "code")
        .agg(F.count("*").cast("int").alias("n"))
    )


def apply_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Adds `baselined`: the first n findings of a rule in a file, by line, are known already."""
    b = baseline.select("repo", F.col("path").alias("b_path"), "code", F.col("n").alias("budget"))
    keyed = findings.withColumn("b_path", normal_path(F.col("path"))).join(b, ["repo", "b_path", "code"], "left")
    place = F.row_number().over(Window.partitionBy("repo", "b_path", "code").orderBy("line", "col", "pattern"))
    return keyed.withColumn("baselined", place <= F.coalesce("budget", F.lit(0))).drop("b_path", "budget")


def _helpers(safe_patterns: DataFrame, respect_prefixes: bool) -> DataFrame:
    """Trusted helpers: (repo, prefix of a rule's code, helpers)."""
    trusted = safe_patterns.where((F.col("confidence") >= 0.6) & (F.col("observed") >= 2))
    codes = trusted.select("repo", F.col("function").alias("helper"), F.explode("codes").alias("prefix")).distinct()
    if respect_prefixes:
        from .learning import KNOWN_HELPERS

        known = F.create_map(*[x for k, v in KNOWN_HELPERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        codes = codes.where(F.exists(
            F.coalesce(F.try_element_at(known, F.col("helper")), F.array(F.col("prefix"))),
            lambda p: F.startswith(F.col("prefix"), p),
        ))
    return codes.groupBy("repo", "prefix").agg(F.collect_set("helper").alias("helpers"))


def _prefixes() -> Column:
    return F.transform(F.sequence(F.lit(1), F.length("code")), lambda n: F.substring("code", F.lit(1), n))


def _covered(findings: DataFrame, lists: DataFrame) -> DataFrame:
    """Adds `covered`: does a line around a finding hold a helper of its rule? `lists` (repo, code, helpers)."""
    near = F.coalesce(F.exists("near", lambda l: F.exists("helpers", lambda h: F.contains(l, h))), F.lit(False))
    return meet(findings, lists, ["repo", "code"], "left").select(*[f"`{c}`" for c in findings.columns], near.alias("covered"))


def helpers_nearby(findings: DataFrame, safe_patterns: DataFrame, codes: Sequence[str], respect_prefixes: bool = False) -> DataFrame:
    """Adds `covered` to findings of the given rules that carry `near`; for use where these lines are, before findings are moved."""
    rules = findings.sparkSession.createDataFrame([(c,) for c in sorted(set(codes))], "code string").select("code", F.explode(_prefixes()).alias("prefix"))
    lists = _helpers(safe_patterns, respect_prefixes).join(F.broadcast(rules), "prefix")
    return _covered(findings, lists.groupBy("repo", "code").agg(F.array_distinct(F.flatten(F.collect_list("helpers"))).alias("helpers")))


def learned_suppression(findings: DataFrame, safe_patterns: DataFrame | None = None, respect_prefixes: bool = False) -> DataFrame:
    """Drop findings with a trusted helper within three lines.

    `findings` carries `near` (the lines around), or `covered` where `helpers_nearby` has judged them already. Helpers are gathered
    for each (repo, rule) that occurs, by the prefixes of the rule's code and without any text; each finding then meets the list of
    its rule once.
    """
    if safe_patterns is not None:
        rules = findings.select("repo", "code").distinct().select("repo", "code", F.explode(_prefixes()).alias("prefix"))
        lists = rules.join(_helpers(safe_patterns, respect_prefixes), ["repo", "prefix"]).groupBy("repo", "code").agg(F.array_distinct(F.flatten(F.collect_list("helpers"))).alias("helpers"))
        findings = _covered(findings, lists)
    return findings.where(~F.col("covered")).drop("near", "covered")


def at_least(findings: DataFrame, level: str) -> DataFrame:
    return findings.where(F.col("severity") >= {"info": 0, "warning": 1, "error": 2}[level])


def without_info(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity") != 0)


def internal_paths(findings: DataFrame) -> DataFrame:
    """On internal paths: reminders go, warnings become reminders, errors stay."""
    internal = F.col("path").rlike(INTERNAL_PATHS)
    kept = findings.where(~(internal & (F.col("severity") == 0)))
    return kept.withColumn(
        "severity", F.when(internal & (F.col("severity") == WARNING), 0).otherwise(F.col("severity"))
    )


def _holds(name: str):
    return lambda line: line.contains(name)


# Names that an ignore list should cover.
SENSITIVE_NAMES = [".env", "credentials.json", "serviceAccountKey"]


def uncovered_names(repos: DataFrame, ignore_lists: DataFrame) -> DataFrame:
    """One finding per repository whose .gitignore misses sensitive names. `repos` (repo),
    `ignore_lists` (repo, content)."""
    entries = F.filter(
        F.transform(F.split("content", "\n"), lambda l: F.regexp_replace(l, r"^\s+|\s+$", "")),
        lambda l: (l != "") & ~l.startswith("#"),
    )
    covers = [F.max(F.exists(entries, _holds(n))).alias(f"c{i}") for i, n in enumerate(SENSITIVE_NAMES)]
    listed = ignore_lists.groupBy("repo").agg(*covers)
    joined = repos.select("repo").distinct().join(listed, "repo", "left")
    missing = F.concat_ws(", ", *[
        F.when(~F.coalesce(F.col(f"c{i}"), F.lit(False)), n) for i, n in enumerate(SENSITIVE_NAMES)
    ])
    joined = joined.withColumn("missing", missing).where(F.col("missing") != "")
    path = F.when(F.col("c0").isNull(), ".gitignore (missing)").otherwise(".gitignore")
    return joined.select(
        "repo", path.alias("path"), F.lit("ignore").alias("language"), F.lit(0).alias("line"), F.lit(0).alias("col"),
        F.lit("CRED007a").alias("code"), F.lit(WARNING).alias("severity"), F.lit("secrets-credentials").alias("category"),
        F.concat(F.lit(".gitignore does not cover: "), "missing").alias("message"),
        F.concat(F.lit("Add to .gitignore: "), "missing").alias("suggestion"), F.col("missing").alias("pattern"),
    )
