"""Scans for SQL users: findings as a view over any table or view of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules.tables import rules_of
from ..sources.files import NO_LIMITS, Limits, language
from .scan import scan


def findings_view(spark: SparkSession, files: str, view: str = "findings", rules: str | None = None, taint: bool = True, limits: Limits = NO_LIMITS) -> DataFrame:
    """Register the findings of a table (path, content and, if there, repo and language) as a temporary view.

    `rules` names a table of rules (see `rules.tables.SCHEMA`) to use in place of the catalogue. The view is a plan: a query on it scans what
    the files hold by then, and its tests on repo, path and language are made before any text is read.
    """
    table = spark.table(files)
    repo = F.col("repo") if "repo" in table.columns else F.lit("")
    kind = F.col("language") if "language" in table.columns else language(F.col("path"))
    given = table.select(repo.alias("repo"), F.col("path"), kind.alias("language"), F.col("content"))
    found = scan(given, rules_of(spark.table(rules)) if rules else None, taint, limits)
    found.createOrReplaceTempView(view)
    return found
