"""One document for each workspace, written by many tasks.

A document is a head, any number of entries with commas between them, and a tail, as lines in order. Lines are sorted by
ranges over the whole table, so that a large workspace is written by several tasks, each a stretch of its lines in a file of its
own; the files of a workspace, one after another by name, are the document. No task holds more than a stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .export import SARIF_SCHEMA, category_label, exported, rule_index, sarif_result
from .joining import meet

_PLACE = ["repo", "section", "place", "body"]


def framed(entries: DataFrame, frames: DataFrame) -> DataFrame:
    """Lines (repo, section, place, body) of documents: entries (repo, place, body) between the head and tail of frames (repo, head, tail).

    `place` orders the entries of a repository. Entries that are equal stay as often as they occur.
    """
    once = entries.groupBy("repo", "place", "body").agg(F.count(F.lit(1)).alias("times"))
    first = entries.groupBy("repo").agg(F.min(F.struct("place", "body")).alias("first"))
    met = meet(once, first, ["repo"])
    comma = F.when(F.struct("place", "body") == F.col("first"), "").otherwise(",")
    repeated = F.concat(comma, F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("times")), lambda _: F.col("body")), "\n,"))
    middle = met.select("repo", F.lit(1).alias("section"), "place", repeated.alias("body"))
    nowhere = F.lit(None).cast(entries.schema["place"].dataType).alias("place")
    ends = [frames.select("repo", F.lit(n).alias("section"), nowhere, F.col(c).alias("body")) for n, c in ((0, "head"), (2, "tail"))]
    return ends[0].unionByName(middle).unionByName(ends[1])


def write_framed(lines: DataFrame, path: str) -> None:
    """Write documents as text below a folder for each repository; see the module for how files make a document."""
    ordered = lines.repartitionByRange(*_PLACE).sortWithinPartitions(*_PLACE)
    ordered.select("repo", F.col("body").alias("value")).write.mode("overwrite").partitionBy("repo").text(path)


def _place(*names: str) -> Column:
    return F.struct(*names).alias("place")


def sarif_lines(findings: DataFrame, tool: str = "seclake", version: str = "1.0.0") -> DataFrame:
    """A SARIF 2.1.0 log for each repository; rule indexes hold across it. A line is an entry of its results."""
    index = rule_index(findings)
    indexed = meet(findings, index, ["repo", "code"])
    body = F.to_json(sarif_result(F.col("rule_index")))
    entries = indexed.select("repo", _place("path", "line", "col", "code", "pattern"), body.alias("body"))
    # A repository has as many rules as the catalogue at most.
    told = findings.groupBy("repo", "code").agg(F.min(F.struct("path", "line", "message", "suggestion", "category")).alias("f")).join(index, ["repo", "code"])
    rule = F.struct(
        F.col("code").alias("id"), F.struct(F.col("f.message").alias("text")).alias("shortDescription"), F.struct(F.col("f.suggestion").alias("text")).alias("fullDescription"),
        F.struct(category_label(F.col("f.category")).alias("category")).alias("properties"),
    )
    rules = told.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("rule_index", rule.alias("rule")))).alias("rules"))
    driver = F.to_json(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.transform("rules", lambda r: r["rule"]).alias("rules")))
    head = F.concat(F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":'), driver, F.lit('},"results":['))
    return framed(entries, rules.select("repo", head.alias("head"), F.lit("]}]}").alias("tail")))


def baseline_lines(baseline: DataFrame, generated_by: str = "seclake") -> DataFrame:
    """A version-1 baseline for each repository. A line is a path with the counts of its rules."""
    codes = baseline.groupBy("repo", "path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "n")))).alias("codes"))
    pair = F.to_json(F.create_map("path", "codes"))
    entries = codes.select("repo", _place("path"), F.substring(pair, F.lit(2), F.length(pair) - 2).alias("body"))
    head = F.lit(f'{{"version":1,"generatedBy":"{generated_by}","counts":{{')
    return framed(entries, baseline.select("repo").distinct().select("repo", head.alias("head"), F.lit("}}").alias("tail")))


def issue_lines(findings: DataFrame, mask: bool = True) -> DataFrame:
    """A document of all issues for each repository."""
    rows = exported(findings, mask)
    fields = [c for c in rows.columns if c != "repo"]
    entries = rows.select("repo", _place("file", "line", "column", "code"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields])).alias("body"))
    return framed(entries, findings.select("repo").distinct().select("repo", F.lit('{"issues":[').alias("head"), F.lit("]}").alias("tail")))

