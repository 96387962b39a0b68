"""Counts, score, gate and listings over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import CATEGORY_LABELS, SEVERITY_LABELS
from ..sources.files import EDITOR_LANGUAGES, extension, scannable
from .lifecycle import open_findings


def _label(labels: dict, key: Column) -> Column:
    chain = None
    for k, v in labels.items():
        chain = F.when(key == k, v) if chain is None else chain.when(key == k, v)
    return chain


def severity_label(severity: Column) -> Column:
    return _label(SEVERITY_LABELS, severity)


def category_label(category: Column) -> Column:
    return F.coalesce(_label(CATEGORY_LABELS, category), category)


def summary(findings: DataFrame) -> DataFrame:
    """(repo, kind, key, n) by category, severity and file, in one pass by grouping sets."""
    named = findings.select(
        "repo", category_label(F.col("category")).alias("category"), severity_label(F.col("severity")).alias("severity"), "path"
    )
    sets = named.groupingSets(
        [["repo", "category"], ["repo", "severity"], ["repo", "path"], ["repo"]], "repo", "category", "severity", "path"
    ).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    # Bits from the left: repo, category, severity, path; a set bit is a column left out.
    kind = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "severity").when(F.col("g") == 6, "file").otherwise("total")
    return sets.select("repo", kind.alias("kind"), F.coalesce("category", "severity", "path", F.lit("")).alias("key"), "n")


def fail_gate(findings: DataFrame, fail_on: str) -> DataFrame:
    """(repo, worst, exit_code): 1 when the worst severity reaches the threshold."""
    threshold = {"info": 0, "warning": 1, "error": 2, "never": 99}[fail_on]
    worst = findings.groupBy("repo").agg(F.max("severity").alias("worst"))
    return worst.withColumn("exit_code", F.when(F.col("worst") >= threshold, 1).otherwise(0))


def scan_totals(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(repo, files_scanned, files_skipped, total_findings); all listed files count as scanned."""
    skipped = ~scannable(F.col("path"), F.col("content"))
    seen = files.groupBy("repo").agg(
        F.count("*").alias("files_scanned"), F.sum(F.when(skipped, 1).otherwise(0)).alias("files_skipped")
    )
    found = findings.groupBy("repo").agg(F.count("*").alias("total_findings"))
    return seen.join(found, "repo", "left").withColumn("total_findings", F.coalesce("total_findings", F.lit(0)))


def security_score(files: DataFrame, findings: DataFrame, statuses: DataFrame) -> DataFrame:
    """(repo, files, open, penalty, score, grade) over findings that are not resolved."""
    weight = F.when(F.col("severity") == 2, 3.0).when(F.col("severity") == 1, 1.5).otherwise(0.5)
    weighed = open_findings(findings, statuses).groupBy("repo").agg(
        F.count("*").alias("open"), F.sum(weight).alias("penalty")
    )
    counted = files.groupBy("repo").agg(F.countDistinct("path").alias("files")).join(weighed, "repo", "left")
    penalty = F.coalesce("penalty", F.lit(0.0))
    score = F.greatest(F.lit(0), F.floor(100 - penalty / F.col("files") * 5 + 0.5)).cast("int")
    return counted.select(
        "repo", "files", F.coalesce("open", F.lit(0)).alias("open"), penalty.alias("penalty"), score.alias("score"),
        grade(score).alias("grade"),
    )


def grade(score: Column) -> Column:
    return (
        F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    )


def browse(
    findings: DataFrame, severities: list[str] | None = None, category: str | None = None, path: str | None = None,
    status: str | None = None, search: str = "", sort: str = "severity", ascending: bool = True,
) -> DataFrame:
    """Filter and order a listing; text orders without case."""
    shown = findings.withColumn("severity_label", severity_label(F.col("severity"))).withColumn(
        "category_label", category_label(F.col("category"))
    )
    if severities:
        shown = shown.where(F.col("severity_label").isin(severities))
    if category:
        shown = shown.where(F.col("category_label") == category)
    if path:
        shown = shown.where(F.col("path") == path)
    if status:
        shown = shown.where(F.col("status") == status)
    if search:
        hay = F.lower(F.concat_ws(" ", "message", "code", "path", "suggestion", "category_label"))
        shown = shown.where(hay.contains(search.lower()))
    key = F.lower(sort) if dict(shown.dtypes)[sort] == "string" else F.col(sort)
    return shown.orderBy(key.asc() if ascending else key.desc(), "repo", "path", "line", "code")


def first_findings(findings: DataFrame, limit: int = 200, level: str = "info") -> DataFrame:
    """The first findings in scan order with a flag that says whether more exist."""
    kept = findings.where(F.col("severity") >= {"info": 0, "warning": 1, "error": 2}[level])
    total = kept.agg(F.count("*"))
    top = kept.orderBy("repo", "path", "line", "code", "col").limit(limit)
    return top.withColumn("total_findings", total.scalar()).withColumn("truncated", F.col("total_findings") > limit)


def scan_estimate(files: DataFrame, batch: int = 50) -> DataFrame:
    """(language, files, batches) for a planned scan, by the editor's languages."""
    known = [(e, l) for l, es in EDITOR_LANGUAGES.items() for e in es]
    lang = F.try_element_at(F.create_map(*[F.lit(x) for kv in known for x in kv]), extension(F.col("path")))
    return (
        files.select(lang.alias("language")).where(F.col("language").isNotNull())
        .groupBy("language").agg(F.count("*").alias("files"))
        .withColumn("batches", F.ceil(F.col("files") / batch).cast("bigint"))
    )


def display_text(code: Column, category: Column, message: Column, confidence: Column) -> Column:
    prefix = (
        F.when(confidence == "critical", "[Critical] ").when(confidence == "safe", "[Safe] ")
        .when(confidence.isNotNull(), "[Verify Needed] ").otherwise("")
    )
    return F.concat(prefix, F.lit("["), category_label(category), F.lit("] "), code, F.lit(": "), message)
