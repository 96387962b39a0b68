"""What happened to findings between scans: status, resolution, verification, regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .suppression import KEY

PRINT = ["repo", "path", "code", "line", "pattern"]
STATUSES = ["pending", "fixed", "ignored", "fix-failed", "verified"]
RESOLVED = ["fixed", "verified", "ignored"]


def latest_status(statuses: DataFrame) -> DataFrame:
    """The last record of each finding."""
    return statuses.groupBy(*KEY).agg(F.max_by(F.struct("status", "at"), F.col("at")).alias("s")).select(*KEY, "s.*")


def with_status(findings: DataFrame, statuses: DataFrame) -> DataFrame:
    return findings.join(statuses.select(*KEY, "status"), KEY, "left").withColumn(
        "status", F.coalesce("status", F.lit("pending"))
    )


def status_summary(statuses: DataFrame) -> DataFrame:
    """One row per repository: total and a count per status."""
    def n(s: str) -> Column:
        return F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s.replace("-", "_"))

    return statuses.groupBy("repo").agg(F.count("*").alias("total"), *[n(s) for s in STATUSES])


def scan_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings in only one of two scans, with `change` resolved or new. Membership, not multiplicity."""
    gone = old.select(*PRINT).distinct().join(new.select(*PRINT), PRINT, "left_anti")
    come = new.select(*PRINT).distinct().join(old.select(*PRINT), PRINT, "left_anti")
    return gone.withColumn("change", F.lit("resolved")).unionByName(come.withColumn("change", F.lit("new")))


def persisting(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.select(*PRINT).distinct().join(old.select(*PRINT), PRINT, "left_semi")


def auto_verified(old: DataFrame, new: DataFrame, statuses: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """Findings of the old scan that a rescan of their file shows as resolved.

    A finding below the first line counts as moved, not resolved, while its rule and matched text are
    still in the file. `scanned` (repo, path) limits the comparison to files that were rescanned.
    """
    gone = old.select(*PRINT).distinct().join(new.select(*PRINT), PRINT, "left_anti")
    if scanned is not None:
        gone = gone.join(scanned.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    still = new.select("repo", "path", "code", "pattern", F.lit(True).alias("moved")).distinct()
    gone = gone.join(still, ["repo", "path", "code", "pattern"], "left").where(
        (F.col("line") == 0) | F.col("moved").isNull()
    )
    settled = statuses.where(F.col("status").isin("verified", "ignored")).select(*KEY)
    return gone.select(*PRINT).join(settled, KEY, "left_anti")


def verify_fixes(statuses: DataFrame, findings: DataFrame) -> DataFrame:
    """Records marked fixed: verified when the rule no longer fires on that line, else still present."""
    present = findings.select("repo", "path", "code", "line", F.lit(True).alias("present")).distinct()
    fixed = statuses.where(F.col("status") == "fixed").select(*KEY)
    return fixed.join(present, ["repo", "path", "code", "line"], "left").select(
        *KEY, F.when(F.col("present"), "still-present").otherwise("verified").alias("outcome")
    )


def regressions(findings: DataFrame, statuses: DataFrame, known: DataFrame) -> DataFrame:
    """Findings of a rule that was verified as fixed in the same file, once per (repo, path, code, line)."""
    fixed = (
        statuses.where(F.col("status") == "verified").groupBy("repo", "path", "code")
        .agg(F.min("at").alias("previously_fixed_at"))
    )
    places = findings.select("repo", "path", "code", "line").distinct()
    return places.join(fixed, ["repo", "path", "code"]).join(
        known.select("repo", "path", "code", "line"), ["repo", "path", "code", "line"], "left_anti"
    )


def triage_queue(findings: DataFrame, statuses: DataFrame) -> DataFrame:
    """Pending findings, gravest first."""
    open_ones = with_status(findings, statuses).where(F.col("status") == "pending")
    return open_ones.orderBy(F.col("severity").desc(), "repo", "path", "line", "code")


def open_findings(findings: DataFrame, statuses: DataFrame) -> DataFrame:
    return with_status(findings, statuses).where(~F.col("status").isin(RESOLVED))


def posture(findings_by_scan: DataFrame) -> DataFrame:
    """Per scan: totals, errors, and how many findings came and went since the scan before.

    Scans are numbered per repository in `seq`. A finding is resolved in scan s when it was in s-1 and
    is not in s. Counting by (finding, next scan) needs one grouping instead of a join of all pairs.
    """
    seen = findings_by_scan.select("repo", "seq", "path", "code", "line", "pattern", "severity")
    scans = seen.groupBy("repo", "seq").agg(
        F.count("*").alias("total"), F.sum(F.when(F.col("severity") == 2, 1).otherwise(0)).alias("critical")
    )
    prints = seen.select("repo", "seq", "path", "code", "line", "pattern").distinct()
    life = Window.partitionBy("repo", "path", "code", "line", "pattern").orderBy("seq")
    prints = prints.withColumn("before", F.lag("seq").over(life)).withColumn("after", F.lead("seq").over(life))
    came = prints.where(F.col("before").isNull() | (F.col("before") != F.col("seq") - 1)).groupBy("repo", "seq").agg(
        F.count("*").alias("new_since_last")
    )
    went = (
        prints.where(F.col("after").isNull() | (F.col("after") != F.col("seq") + 1))
        .groupBy("repo", (F.col("seq") + 1).alias("seq")).agg(F.count("*").alias("resolved_since_last"))
    )
    joined = scans.join(came, ["repo", "seq"], "left").join(went, ["repo", "seq"], "left")
    first = Window.partitionBy("repo").orderBy("seq")
    return joined.select(
        "repo", "seq", "total", "critical",
        F.coalesce("resolved_since_last", F.lit(0)).alias("resolved_since_last"),
        F.when(F.row_number().over(first) == 1, 0).otherwise(F.coalesce("new_since_last", F.lit(0))).alias("new_since_last"),
    )


def last_per_repo(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows per repository in the given order (retention of scans, postures, fixes)."""
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy("repo").orderBy(*order)))
    return ranked.where(F.col("_place") <= limit).drop("_place")
