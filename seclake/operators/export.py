"""Findings as JSON, CSV, SARIF, text and baseline documents.

A document per repository could hold any number of findings, so documents are cut per file: a file's
findings are bounded by its size. Each SARIF log and each baseline document is complete and valid by
itself; readers of both formats accept many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import normal_path
from ..rules import CATEGORY_LABELS
from .history import masked
from .statistics import category_label, severity_label

SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"
CSV_HEADER = "File,Line,Column,Severity,Code,Category,Message,Suggestion"


def exported(findings: DataFrame, mask: bool = False) -> DataFrame:
    """Export columns: labels, and places counted from 1. `mask` hides the matched text."""
    pattern = F.sha2("pattern", 256) if mask else F.col("pattern")
    return findings.select(
        "repo", F.col("path").alias("file"), (F.col("line") + 1).alias("line"), (F.col("col") + 1).alias("column"),
        severity_label(F.col("severity")).alias("severity"), "code", category_label(F.col("category")).alias("category"),
        "message", "suggestion", pattern.alias("pattern"),
    )


def json_rows(findings: DataFrame, mask: bool = False) -> DataFrame:
    out = exported(findings, mask)
    return out.select("repo", F.to_json(F.struct(*[c for c in out.columns if c != "repo"])).alias("json"))


def advisory_json_rows(advisories: DataFrame) -> DataFrame:
    return advisories.select("repo", F.to_json(F.struct(
        F.lit("project-advisory").alias("type"), "code", category_label(F.col("category")).alias("category"), "message", "suggestion",
    )).alias("json"))


def csv_quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_rows(findings: DataFrame) -> DataFrame:
    """One CSV line per finding, without the header; four text columns are always quoted."""
    e = exported(findings)
    line = F.concat_ws(
        ",", csv_quote(F.col("file")), "line", "column", "severity", "code", csv_quote(F.col("category")),
        csv_quote(F.col("message")), csv_quote(F.col("suggestion")),
    )
    return e.select("repo", line.alias("line_text"))


def rule_index(findings: DataFrame) -> DataFrame:
    """(repo, code, rule_index): rules by first appearance in path, line, code order.

    Each rule is first reduced to its first place, so the ranking sees one row per rule and repository.
    """
    first = findings.groupBy("repo", "code").agg(F.min(F.struct("path", "line", "code")).alias("first"))
    return first.select(
        "repo", "code", (F.row_number().over(Window.partitionBy("repo").orderBy("first")) - 1).alias("rule_index")
    )


def sarif_level(severity: Column) -> Column:
    return F.when(severity == 2, "error").when(severity == 1, "warning").otherwise("note")


def sarif_result(index: Column) -> Column:
    return F.struct(
        F.col("code").alias("ruleId"), index.alias("ruleIndex"), sarif_level(F.col("severity")).alias("level"),
        F.struct(F.concat("message", F.lit("\n\nSuggestion: "), "suggestion").alias("text")).alias("message"),
        F.array(F.struct(F.struct(
            F.struct(normal_path(F.col("path")).alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
            F.struct((F.col("line") + 1).alias("startLine"), (F.col("col") + 1).alias("startColumn")).alias("region"),
        ).alias("physicalLocation"))).alias("locations"),
    )


def sarif_rows(findings: DataFrame) -> DataFrame:
    """One SARIF result per finding, with rule indexes that hold across the repository."""
    joined = findings.join(rule_index(findings), ["repo", "code"])
    return joined.select("repo", "path", F.to_json(sarif_result(F.col("rule_index"))).alias("json"))


def sarif_logs(findings: DataFrame, tool: str = "seclake", version: str = "1.0.0") -> DataFrame:
    """(repo, path, sarif): a complete SARIF 2.1.0 log per file."""
    per_file = findings.groupBy("repo", "path").agg(F.sort_array(F.collect_list(F.struct(
        "line", "code", "col", "pattern", "severity", "message", "suggestion", "category"
    ))).alias("found"))
    codes = F.array_distinct(F.transform("found", lambda f: f["code"]))
    # The first finding of each rule, found once by position.
    places = F.transform(codes, lambda c: F.array_position(F.transform("found", lambda f: f["code"]), c))
    per_file = per_file.withColumn("codes", codes).withColumn("rules", F.transform(places, lambda i: F.get("found", (i - 1).cast("int"))))

    def rule(f: Column) -> Column:
        return F.struct(
            f["code"].alias("id"), F.struct(f["message"].alias("text")).alias("shortDescription"),
            F.struct(f["suggestion"].alias("text")).alias("fullDescription"),
            F.struct(category_label(f["category"]).alias("category")).alias("properties"),
        )

    def result(f: Column) -> Column:
        return F.struct(
            f["code"].alias("ruleId"), (F.array_position("codes", f["code"]) - 1).alias("ruleIndex"),
            sarif_level(f["severity"]).alias("level"),
            F.struct(F.concat(f["message"], F.lit("\n\nSuggestion: "), f["suggestion"]).alias("text")).alias("message"),
            F.array(F.struct(F.struct(
                F.struct(normal_path(F.col("path")).alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
                F.struct((f["line"] + 1).alias("startLine"), (f["col"] + 1).alias("startColumn")).alias("region"),
            ).alias("physicalLocation"))).alias("locations"),
        )

    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.transform("rules", rule).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("found", result).alias("results"))
    log = F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return per_file.select("repo", "path", F.to_json(log).alias("sarif"))


def text_reports(findings: DataFrame) -> DataFrame:
    """(repo, path, report): a readable block per file, by line."""
    entry = F.concat(
        F.lit("  ["), severity_label(F.col("severity")), F.lit("] "), "code", F.lit(" (Line "),
        (F.col("line") + 1).cast("string"), F.lit("): "), "message", F.lit("\n    Suggestion: "), "suggestion",
    )
    blocks = findings.groupBy("repo", "path").agg(
        F.sort_array(F.collect_list(F.struct("line", "code", "col", entry.alias("entry")))).alias("entries")
    )
    head = F.concat(F.lit("--- "), "path", F.lit(" ("), F.size("entries").cast("string"), F.lit(" issue(s)) ---"))
    return blocks.select(
        "repo", "path", F.concat_ws("\n", head, F.array_join(F.transform("entries", lambda e: e["entry"]), "\n")).alias("report")
    )


def baseline_documents(baseline: DataFrame, generated_by: str = "seclake") -> DataFrame:
    """(repo, path, json): a version-1 baseline document per file, rules in order."""
    codes = baseline.groupBy("repo", "path").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "n")))).alias("codes")
    )
    doc = F.struct(F.lit(1).alias("version"), F.lit(generated_by).alias("generatedBy"), F.create_map("path", "codes").alias("counts"))
    return codes.select("repo", "path", F.to_json(doc).alias("json"))


def history_text(findings: DataFrame) -> DataFrame:
    """(repo, sha, path, line, text): display lines of a history scan; matches are cut to 80 characters."""
    text = F.concat(
        F.lit("  ["), "severity", F.lit("] "), "code", F.lit("  "), "path", F.lit(":"), F.col("line").cast("string"),
        F.lit("\n    "), "message", F.lit("\n    match: "), masked(F.col("match")),
    )
    head = F.concat(F.lit("commit "), F.substring("sha", 1, 12), F.lit(" - "), "author")
    return findings.select("repo", "sha", "path", "line", "code", head.alias("commit"), text.alias("text"))


def history_json(findings: DataFrame) -> DataFrame:
    return findings.select("repo", "sha", F.to_json(F.struct(
        F.col("sha").alias("commitSha"), "author", F.col("committed_at").alias("date"), F.col("path").alias("filePath"),
        F.col("line").alias("lineNumber"), F.col("code").alias("ruleCode"), F.col("message").alias("ruleMessage"),
        "severity", "match",
    )).alias("json"))


def _one_file_each(rows: DataFrame) -> DataFrame:
    """Deal rows to tasks by repository, splitting large ones, so that a task writes few folders."""
    return rows.hint("rebalance", "repo")


def write_advisories(advisories: DataFrame, path: str) -> None:
    """Project advisories as JSON lines, beside the findings of `write_json`."""
    write_documents(advisory_json_rows(advisories), "json", path)


def write_json(findings: DataFrame, path: str, mask: bool = True) -> None:
    _one_file_each(exported(findings, mask)).write.mode("overwrite").partitionBy("repo").json(path)


def write_csv(findings: DataFrame, path: str) -> None:
    out = _one_file_each(exported(findings).drop("pattern"))
    out.write.mode("overwrite").partitionBy("repo").option("header", "true").option("quoteAll", "true").csv(path)


def write_documents(documents: DataFrame, column: str, path: str) -> None:
    """Text documents (SARIF logs, reports, baselines), one per line of partitioned text files."""
    _one_file_each(documents.select("repo", F.col(column).alias("value"))).write.mode("overwrite").partitionBy("repo").text(path)


def append_table(rows: DataFrame, path: str) -> None:
    """Append to a log: scans, ignore entries, actions."""
    rows.write.mode("append").partitionBy("repo").parquet(path)


def scan_record(findings: DataFrame, files: DataFrame, scan_id: Column, ts: Column, scan_type: str, duration_ms: Column) -> DataFrame:
    """One scan-history row per repository, with counts by severity and category as maps of fixed size."""
    sevs = {l: s for s, l in (("2", "Error"), ("1", "Warning"), ("0", "Info"))}
    by_severity = [x for l, s in sevs.items() for x in (F.lit(l), F.sum(F.when(F.col("severity") == int(s), 1).otherwise(0)))]
    by_category = [x for c, l in CATEGORY_LABELS.items() for x in (F.lit(l), F.sum(F.when(F.col("category") == c, 1).otherwise(0)))]
    found = findings.groupBy("repo").agg(
        F.count("*").alias("total_issues"), F.map_filter(F.create_map(*by_severity), lambda k, v: v > 0).alias("by_severity"),
        F.map_filter(F.create_map(*by_category), lambda k, v: v > 0).alias("by_category"),
    )
    counted = files.groupBy("repo").agg(F.count("*").alias("total_files"))
    none = F.create_map().cast("map<string,bigint>")
    return counted.join(found, "repo", "left").select(
        "repo", scan_id.alias("scan_id"), ts.alias("ts"), F.lit(scan_type).alias("scan_type"),
        duration_ms.cast("bigint").alias("duration_ms"), "total_files",
        F.coalesce("total_issues", F.lit(0)).alias("total_issues"),
        F.coalesce("by_severity", none).alias("by_severity"), F.coalesce("by_category", none).alias("by_category"),
    )
