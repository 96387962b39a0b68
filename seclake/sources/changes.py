"""Narrow a scan to what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _after_first(parts: Column) -> Column:
    return F.slice(parts, F.lit(2), F.size(parts))


def changed_since(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Files named in a change list; deletions do not count."""
    wanted = changes.where(F.col("status") != "D").select("repo", "path").distinct()
    return files.join(wanted, ["repo", "path"], "left_semi")


def uncommitted(changes: DataFrame) -> DataFrame:
    """Modified, staged and untracked paths, each once."""
    kinds = [changes.where(F.col("kind") == k).select("repo", "path") for k in ("modified", "staged", "untracked")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).where(F.col("path") != "").distinct()


def branch_files(files: DataFrame, commits: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Files touched by commits after the point where the branch left main or master.

    `commits` (repo, path, seq, base_seq, branch): base_seq is null where neither base branch exists.
    """
    after = commits.where(
        ~F.col("branch").isin("main", "master") & F.col("base_seq").isNotNull() & (F.col("seq") > F.col("base_seq"))
    )
    kept = files.join(after.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    return kept.where(F.col("language").isin(languages)) if languages else kept


def latest_commits(patches: DataFrame, limit: int) -> DataFrame:
    """The most recent commits of each repository; 0 keeps all."""
    if not limit:
        return patches
    from pyspark.sql import Window

    newest = Window.partitionBy("repo").orderBy(F.col("committed_at").desc(), "sha")
    commits = patches.select("repo", "sha", "committed_at").distinct()
    kept = commits.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= limit).drop("n", "committed_at")
    return patches.join(kept, ["repo", "sha"], "left_semi")


def _file_of(part: Column) -> Column:
    return F.nullif(F.regexp_extract(part, r"\Aa/(.+?) b/([^\n]+)", 2), F.lit(""))


def added_lines(patches: DataFrame) -> DataFrame:
    """Every added line of every patch with its file and its line number after the change.

    A patch is cut into files and a file into hunks inside its own row; within a hunk, the place of a
    line among the lines that survive the change is its offset. No window and no shuffle.
    """
    kept = [c for c in patches.columns if c != "patch"]
    per_file = patches.select(
        *kept,
        F.explode(_after_first(F.split(F.concat(F.lit("\n"), "patch"), r"\ndiff --git "))).alias("part"),
    )
    per_file = per_file.withColumn("path", _file_of(F.col("part"))).where(F.col("path").isNotNull())
    hunks = per_file.select(
        *kept, "path",
        F.explode(F.split("part", r"\n(?=@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)")).alias("hunk"),
    )
    start = F.regexp_extract("hunk", r"\A@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1)
    body = _after_first(F.split("hunk", "\n"))
    body = F.filter(body, lambda l: l.startswith(" ") | (l.startswith("+") & ~l.startswith("+++")))
    numbered = hunks.select(
        *kept, "path", F.when(start != "", start.cast("int")).otherwise(0).alias("start"),
        F.posexplode(body).alias("offset", "raw"),
    )
    return numbered.where(F.col("raw").startswith("+")).select(
        *kept, "path", (F.col("start") + F.col("offset")).alias("line"),
        F.expr("substring(raw, 2)").alias("text"),
    )
