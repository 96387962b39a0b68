"""Ignore files and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normal_path


def ignore_entries(files: DataFrame) -> DataFrame:
    """Entries `RULE path[:line] [# reason]` from a table (repo, content) of ignore files."""
    raw = files.select("repo", F.explode(F.split("content", "\n")).alias("raw"))
    line = F.regexp_replace("raw", r"^\s+|\s+$", "")
    raw = raw.withColumn("entry", line).where((F.col("entry") != "") & ~F.col("entry").startswith("#"))
    has_reason = F.col("entry").contains("#")
    main = F.regexp_replace(F.substring_index("entry", "#", 1), r"^\s+|\s+$", "")
    reason = F.when(has_reason, F.regexp_replace(F.regexp_extract("entry", r"#(.*)$", 1), r"^\s+|\s+$", ""))
    parts = F.split(main, r"\s+")
    raw = raw.select("repo", parts.alias("parts"), F.nullif(reason, F.lit("")).alias("reason"))
    raw = raw.where(F.size("parts") >= 2)
    spec = F.col("parts")[1]
    # A trailing number above zero is the line, even when other characters follow it.
    number = F.regexp_extract(spec, r":\s*\+?0*([1-9]\d*)[^:]*$", 1)
    lined = number != ""
    path = F.when(lined, F.regexp_replace(spec, r":[^:]*$", "")).otherwise(spec)
    return raw.select(
        "repo", F.col("parts")[0].alias("code"), normal_path(path).alias("path"),
        F.when(lined, number.cast("int")).alias("line"), "reason",
    )


def ignore_line(code: Column, path: Column, line: Column, reason: Column) -> Column:
    """One entry as text, for an ignore file."""
    return F.concat(
        code, F.lit(" "), normal_path(path),
        F.coalesce(F.concat(F.lit(":"), line.cast("string")), F.lit("")),
        F.coalesce(F.concat(F.lit(" # "), F.nullif(reason, F.lit(""))), F.lit("")),
    )


def _baselines(files: DataFrame) -> DataFrame:
    doc = F.from_json("content", "version int, counts map<string, map<string, int>>")
    return files.select("repo", doc.alias("doc")).withColumn("good", F.coalesce((F.col("doc.version") == 1) & F.col("doc.counts").isNotNull(), F.lit(False)))


def baseline_entries(files: DataFrame, strict: bool = False) -> DataFrame:
    """(repo, path, code, n) from baseline documents (repo, content) of version 1.

    Documents of another shape are left out and told by `rejected_baselines`, so that one of them does not stop the others;
    `strict` fails instead.
    """
    parsed = _baselines(files)
    if strict:
        message = F.lit("baseline has an unsupported shape: expected version 1 with counts")
        parsed = parsed.where(F.assert_true(F.col("good"), message).isNull())
    per_file = parsed.where("good").select("repo", F.explode("doc.counts").alias("path", "codes"))
    return per_file.select("repo", "path", F.explode("codes").alias("code", "n"))


def rejected_baselines(files: DataFrame) -> DataFrame:
    """(repo, version): documents that are not baselines of version 1."""
    return _baselines(files).where(~F.col("good")).select("repo", F.col("doc.version").alias("version"))
