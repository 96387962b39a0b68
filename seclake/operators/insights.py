"""Short statements for a dashboard, from scans, rule statistics, fixes, regressions and hot zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.workspace import written

_ORDER = {"warning": 0, "suggestion": 1, "celebration": 2, "info": 3}


def _rows(found: DataFrame, kind: Column | str, severity: Column | str, title: Column, detail: Column) -> DataFrame:
    as_col = lambda c: F.lit(c) if isinstance(c, str) else c
    return found.select(
        as_col(kind).alias("type"), as_col(severity).alias("severity"), title.alias("title"), detail.alias("detail")
    )


def rounded(c: Column) -> Column:
    """Round half up, towards plus infinity."""
    return F.floor(c + 0.5).cast("bigint")


def trend(scans: DataFrame) -> DataFrame:
    """(repo, recent_avg, previous_avg, change, direction): the last three scans against the three before.

    Nothing is said with fewer than six scans, or when the earlier mean is zero.
    """
    newest = Window.partitionBy("repo").orderBy(F.col("ts").desc(), F.col("scan_id").desc())
    ranked = scans.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= 6)
    mean = ranked.groupBy("repo").agg(
        F.avg(F.when(F.col("n") <= 3, F.col("total_issues"))).alias("recent_avg"),
        F.avg(F.when(F.col("n") > 3, F.col("total_issues"))).alias("previous_avg"),
        F.count("*").alias("n"),
    ).where((F.col("n") == 6) & (F.col("previous_avg") != 0)).drop("n")
    change = (F.col("recent_avg") - F.col("previous_avg")) / F.col("previous_avg") * 100
    return mean.withColumn("change", change).withColumn(
        "direction", F.when(F.col("change") <= -10, "improving").when(F.col("change") >= 15, "degrading").otherwise("steady")
    )


def trend_insights(scans: DataFrame) -> DataFrame:
    told = trend(scans).where(F.col("direction") != "steady")
    better = F.col("direction") == "improving"
    return _rows(
        told, F.concat(F.lit("trend_"), "direction"), F.when(better, "celebration").otherwise("warning"),
        F.concat("repo", F.when(better, ": posture improves").otherwise(": findings increase")),
        F.format_string("%d%% change over three scans (%d on average, %d before)", rounded(F.abs("change")),
                        rounded(F.col("recent_avg")), rounded(F.col("previous_avg"))),
    )


def rule_statements(insights: DataFrame) -> DataFrame:
    def pick(mapping: dict[str, str]) -> Column:
        chain = None
        for k, v in mapping.items():
            chain = F.when(F.col("type") == k, v) if chain is None else chain.when(F.col("type") == k, v)
        return chain

    kinds = {"high_fp_rate": "rule_noisy", "highly_effective": "rule_effective", "never_acted_on": "stale_issues",
             "ai_fix_struggles": "ai_fix_effective"}
    levels = {"high_fp_rate": "suggestion", "highly_effective": "info", "never_acted_on": "suggestion", "ai_fix_struggles": "info"}
    says = {"high_fp_rate": " is often dismissed", "highly_effective": " is usually acted on",
            "never_acted_on": " is never acted on", "ai_fix_struggles": " resists automatic fixes"}
    share = F.when(F.col("type") == "never_acted_on", F.concat(F.col("value").cast("bigint").cast("string"), F.lit(" detections")))
    share = share.otherwise(F.concat(rounded(F.col("value") * 100).cast("string"), F.lit("%")))
    return _rows(insights, pick(kinds), pick(levels), F.concat("code", pick(says)), share)


def champion_statements(champions: DataFrame) -> DataFrame:
    return _rows(
        champions, "category_champion", "celebration", F.concat("family", F.lit(" is nearly resolved")),
        F.format_string("%d of %d", "resolved", "total"),
    )


def fix_statements(pattern_stats: DataFrame, success: DataFrame) -> DataFrame:
    learned = _rows(
        pattern_stats.where(F.col("total") >= 5), "fix_pattern_available", "info",
        F.format_string("%d fix patterns learned", "total"),
        F.format_string("%d verified, %d applications", "with_successes", "total_reuses"),
    )
    rate = _rows(
        success, "ai_fix_effective", F.col("severity"), F.format_string("Automatic fixes succeed in %d%%", "rate"),
        F.format_string("%d of %d", "succeeded", "attempts"),
    )
    return learned.unionByName(rate)


def regression_summary(regressions: DataFrame) -> DataFrame:
    """(repo, regressions, files, sample): unacknowledged ones, with the first three paths."""
    open_ones = regressions.where(~F.coalesce("acknowledged", F.lit(False)))
    # Stored, as it is read twice and may stand for whole scans.
    per_file = written(open_ones.groupBy("repo", "path").agg(F.count("*").alias("n")))
    totals = per_file.groupBy("repo").agg(F.sum("n").alias("regressions"), F.count("*").alias("files"))
    # Ranked apart from the totals: a rank limit is applied before the exchange, a rank column is not.
    by_path = Window.partitionBy("repo").orderBy("path")
    first = per_file.select("repo", "path", F.row_number().over(by_path).alias("place")).where("place <= 3")
    sample = first.groupBy("repo").agg(F.array_join(F.sort_array(F.collect_list("path")), ", ").alias("sample"))
    return totals.join(sample, "repo")


def regression_statements(regressions: DataFrame) -> DataFrame:
    return _rows(
        regression_summary(regressions), "regression_detected", "warning",
        F.format_string("%s: %d findings came back", "repo", "regressions"),
        F.concat(F.format_string("%d files: ", "files"), "sample", F.when(F.col("files") > 3, "...").otherwise("")),
    )


def top_hot_zone(zones: DataFrame) -> DataFrame:
    """The riskiest zone, when it has enough confirmed findings."""
    top = zones.agg(F.max_by(F.struct("zone", "confirmed", "total", "risk"), F.struct("risk", "zone")).alias("z")).select("z.*")
    return top.where((F.col("risk") >= 0.5) & (F.col("confirmed") >= 5))


def hot_zone_statements(zones: DataFrame) -> DataFrame:
    return _rows(
        top_hot_zone(zones), "hot_zone", "suggestion", F.concat(F.lit("Hot zone: "), "zone"),
        F.format_string("%d of %d detections confirmed", "confirmed", "total"),
    )


def severity_order(severity: Column) -> Column:
    chain = None
    for k, v in _ORDER.items():
        chain = F.when(severity == k, v) if chain is None else chain.when(severity == k, v)
    return chain


def all_insights(*parts: DataFrame) -> DataFrame:
    """Warnings first, then suggestions, celebrations and notes."""
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged.orderBy(severity_order(F.col("severity")), "type", "title")
