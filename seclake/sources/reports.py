"""Reports of package tools and advisory feeds, all as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.versions import update_type

ADVISORY_SCHEMA = (
    "id string, aliases array<string>, summary string, details string,"
    " database_specific struct<severity:string>, severity array<struct<type:string,score:string>>,"
    " affected array<struct<package:struct<name:string,ecosystem:string>,versions:array<string>,"
    "ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>"
)


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """An advisory dump, one JSON record per line."""
    return spark.read.schema(ADVISORY_SCHEMA).json(path)


def parse_advisories(feed: DataFrame) -> DataFrame:
    """Advisories from a table with a JSON column `body`; what is not one is told by `rejected_advisories`."""
    return feed.select(F.from_json("body", ADVISORY_SCHEMA).alias("a")).where(F.col("a.id").isNotNull()).select("a.*")


def rejected_advisories(feed: DataFrame) -> DataFrame:
    """Rows of a feed that hold no advisory, with the reason."""
    parsed = F.from_json("body", ADVISORY_SCHEMA)
    reason = F.when(F.try_parse_json("body").isNull(), "not JSON").when(parsed["id"].isNull(), "no id")
    return feed.withColumn("reason", reason).where(F.col("reason").isNotNull())


def _or(c: Column, other: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(other))


def outdated(reports: DataFrame) -> DataFrame:
    """(repo, name, current, wanted, latest, type, update_type) from `kind = outdated` reports."""
    parsed = reports.where(F.col("kind") == "outdated").select(
        "repo",
        F.explode(F.from_json("body", "map<string,struct<current:string,wanted:string,latest:string,type:string>>"))
        .alias("name", "p"),
    )
    return parsed.select(
        "repo", "name", _or(F.col("p.current"), "N/A").alias("current"), _or(F.col("p.wanted"), "N/A").alias("wanted"),
        _or(F.col("p.latest"), "N/A").alias("latest"),
        F.when(F.col("p.type") == "devDependencies", "devDependencies").otherwise("dependencies").alias("type"),
        update_type(_or(F.col("p.current"), ""), _or(F.col("p.latest"), "")).alias("update_type"),
    )


def audit(reports: DataFrame) -> DataFrame:
    """(repo, name, severity, title, url, range, fix_available); both report layouts are read."""
    bodies = reports.where(F.col("kind") == "audit")
    new = bodies.select(
        "repo",
        F.explode(F.from_json(
            "body", "vulnerabilities map<string,struct<severity:string,via:array<string>,range:string,fixAvailable:string>>"
        )["vulnerabilities"]).alias("name", "v"),
    )
    told = F.get(F.filter("v.via", lambda x: _or(F.get_json_object(x, "$.title"), "") != ""), F.lit(0))
    title = _or(F.get_json_object(told, "$.title"), "")
    new = new.select(
        "repo", "name", _or(F.col("v.severity"), "info").alias("severity"),
        F.when(title == "", F.concat(F.lit("Vulnerability in "), "name")).otherwise(title).alias("title"),
        _or(F.get_json_object(told, "$.url"), "").alias("url"),
        F.coalesce(F.nullif(F.get_json_object(told, "$.range"), F.lit("")), F.col("v.range"), F.lit("")).alias("range"),
        (~F.coalesce(F.col("v.fixAvailable"), F.lit("")).isin("", "false", "0", "null")).alias("fix_available"),
    )
    old = bodies.where(F.get_json_object("body", "$.vulnerabilities").isNull()).select(
        "repo",
        F.explode(F.from_json(
            "body", "advisories map<string,struct<module_name:string,severity:string,title:string,url:string,"
            "vulnerable_versions:string,patched_versions:string>>"
        )["advisories"]).alias("key", "v"),
    )
    patched = _or(F.col("v.patched_versions"), "")
    old = old.select(
        "repo", _or(F.col("v.module_name"), "unknown").alias("name"), _or(F.col("v.severity"), "info").alias("severity"),
        _or(F.col("v.title"), "").alias("title"), _or(F.col("v.url"), "").alias("url"),
        _or(F.col("v.vulnerable_versions"), "").alias("range"),
        ((patched != "") & (patched != "<0.0.0")).alias("fix_available"),
    )
    return new.unionByName(old)
