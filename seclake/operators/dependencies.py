"""Packages against advisories, and dependency findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.versions import (
    advisory_severity, audit_severity, first_fixed, package_name, severity_rank, update_type, version_key, version_range,
)
from ..plans.workspace import written
from ..rules.model import INFO, WARNING

CATEGORY = "dependencies-supply-chain"
ADVISORY_URL = "https://osv.dev/vulnerability/"


PACKAGE = ["ecosystem", "known_as"]


def _spans(ranges: Column) -> Column:
    """array<struct(low, high, last)>: each "introduced" event opens a span that the next "fixed" or "last_affected" event closes."""

    def of(r: Column) -> Column:
        def later(i: Column, field: str) -> Column:
            return F.get(F.filter(F.transform(F.slice(r["events"], i + 2, F.size(r["events"])), lambda x: x[field]), lambda f: f.isNotNull()), F.lit(0))

        opened = F.transform(r["events"], lambda e, i: F.struct(e["introduced"].alias("low"), later(i, "fixed").alias("high"), later(i, "last_affected").alias("last")))
        return F.filter(opened, lambda s: s["low"].isNotNull())

    return F.flatten(F.transform(ranges, of))


def _blocks(low: Column, high: Column) -> Column:
    """array<struct(level, block)>: the interval [low, high) of places as aligned blocks of 1, 2, 4, ... places, two of a size at most."""

    def at(level: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        first, end = F.ceil(low / width).cast("long"), F.floor(high / width).cast("long")
        left = F.when((first < end) & (first % 2 == 1), F.struct(level.alias("level"), first.alias("block")))
        right = F.when((first < end) & (end % 2 == 1), F.struct(level.alias("level"), (end - 1).alias("block")))
        return F.filter(F.array(left, right), lambda b: b.isNotNull())

    # No block is wider than the interval.
    levels = F.sequence(F.lit(0), F.floor(F.log2((high - low).cast("double"))).cast("int"))
    return F.flatten(F.transform(levels, at))


def versions_hit(used: DataFrame, spans: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(ecosystem, known_as, version, id): versions inside a span or on a list, each pair once.

    `used` has a row (ecosystem, known_as, version, key) for each version, `spans` (ecosystem, known_as, id, low, high, last) with
    version keys as ends, of which null ones are open, `listed` (ecosystem, known_as, id, version). Keys and ends of a package are sorted
    once, which turns spans into intervals of places. An interval is a few aligned blocks, a place lies in one block
    of each size, and both meet by equality: no pair is looked at that is no hit, and a package with many
    versions and many spans is spread over its blocks. A version without a key is inside the spans that have no ends.
    """
    text, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    rows = lambda t, turn, key, version=text, span=F.lit(None), opens=flag: t.select(
        *PACKAGE, turn.alias("turn"), key.alias("key"), version.alias("version"), span.cast("struct<id:string,low:string,high:string,last:string>").alias("span"), opens.alias("opens"))
    span, upper = F.struct("id", "low", "high", "last"), F.coalesce("high", "last")
    # An end counts the versions before it: a last version after its equals, other ends before theirs.
    parts = [
        rows(used, F.lit(1), F.col("key"), F.col("version")),
        rows(spans.where("low IS NOT NULL"), F.lit(0), F.col("low"), span=span, opens=F.lit(True)),
        rows(spans.where(upper.isNotNull()), F.when(F.col("high").isNotNull(), 0).otherwise(2), upper, span=span, opens=F.lit(False)),
        rows(spans.where(F.col("low").isNull() & upper.isNull()), F.lit(3), text, span=span),
    ]
    if listed is not None:
        parts.append(rows(listed, F.lit(4), text, F.col("version"), F.struct("id", text.alias("low"), text.alias("high"), text.alias("last"))))
    whole, version = Window.partitionBy(*PACKAGE), F.col("turn") == 1
    count = lambda test, over: F.count(F.when(test, 1)).over(over)
    placed = reduce(DataFrame.unionByName, parts).withColumns({
        "place": count(version, whole.orderBy(F.asc_nulls_first("key"), "turn").rowsBetween(Window.unboundedPreceding, -1)),
        "places": count(version, whole), "odd": count(version & F.col("key").isNull(), whole),
    })
    placed = written(placed.where("places > 0"))
    ends = placed.where("turn IN (0, 2, 3)").groupBy(*PACKAGE, "span").agg(
        F.max(F.when(F.col("opens"), F.col("place"))).alias("begin"), F.max(F.when(~F.col("opens"), F.col("place"))).alias("end"), F.max("places").alias("places"), F.max("odd").alias("odd"),
    )
    free = F.col("begin").isNull() & F.col("end").isNull()
    intervals = ends.select(
        *PACKAGE, F.col("span.id").alias("id"), F.when(free, 0).otherwise(F.coalesce("begin", "odd")).cast("long").alias("begin"), F.coalesce("end", "places").cast("long").alias("end"),
    ).where("begin < end")
    held = intervals.select(*PACKAGE, "id", F.inline(_blocks(F.col("begin"), F.col("end")))).withColumn("label", F.lit(""))
    held = held.unionByName(placed.where("turn = 4").select(*PACKAGE, F.col("span.id").alias("id"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("block"), F.col("version").alias("label")))
    up = F.transform(
        F.sequence(F.lit(0), F.floor(F.log2(F.col("places").cast("double"))).cast("int")),
        lambda l: F.struct(l.alias("level"), F.call_function("shiftright", F.col("place"), l).alias("block"), F.lit("").alias("label")),
    )
    own = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("block"), F.col("version").alias("label")))
    points = placed.where("turn = 1").select(*PACKAGE, "version", F.inline(F.concat(own, up)))
    return points.join(held, [*PACKAGE, "level", "block", "label"]).select(*PACKAGE, "version", "id").distinct()


def vulnerable_packages(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Package rows with the advisories that hit them.

    Versions are compared once per distinct (ecosystem, name, version), however many repositories use
    it, and are parsed once; names meet in the form in which their ecosystem compares them.
    """
    used = packages.select("ecosystem", package_name(F.col("name"), F.col("ecosystem")).alias("known_as"), "version").distinct().withColumn("key", version_key(F.col("version")))
    affected = advisories.select("id", F.explode("affected").alias("a")).select(
        "id", F.col("a.package.ecosystem").alias("ecosystem"), package_name(F.col("a.package.name"), F.col("a.package.ecosystem")).alias("known_as"),
        F.col("a.versions").alias("versions"), F.filter("a.ranges", version_range).alias("ranges"),
    )
    stated = affected.select(*PACKAGE, "id", F.inline(_spans(F.col("ranges"))))
    low, high, last = (version_key(F.col(c)) for c in ("low", "high", "last"))
    # An end that is no version holds nothing.
    lost = (F.col("low") != "0") & low.isNull() | F.col("high").isNotNull() & high.isNull() | F.col("high").isNull() & F.col("last").isNotNull() & last.isNull()
    spans = stated.where(~lost).select(*PACKAGE, "id", F.when(F.col("low") != "0", low).alias("low"), high.alias("high"), F.when(F.col("high").isNull(), last).alias("last"))
    hits = versions_hit(used, spans, affected.select(*PACKAGE, "id", F.explode("versions").alias("version")))

    facts = advisories.select(
        "id", F.coalesce("aliases", F.expr("array()").cast("array<string>")).alias("aliases"),
        F.coalesce(F.nullif("summary", F.lit("")), F.nullif(F.substring_index("details", "\n", 1), F.lit(""))).alias("summary"),
        advisory_severity(F.col("database_specific.severity"), F.transform("severity", lambda s: s["score"])).alias("severity"),
        "affected", F.explode("affected").alias("a"),
    ).select(
        "id", "aliases", "summary", "severity", F.col("a.package.ecosystem").alias("ecosystem"),
        package_name(F.col("a.package.name"), F.col("a.package.ecosystem")).alias("known_as"),
        first_fixed(F.col("affected"), F.col("a.package.name"), F.col("a.package.ecosystem")).alias("fixed_version"),
    ).dropDuplicates([*PACKAGE, "id"])
    told = hits.join(facts, [*PACKAGE, "id"])
    named = packages.withColumn("known_as", package_name(F.col("name"), F.col("ecosystem")))
    found = named.join(told, [*PACKAGE, "version"]).drop("known_as")
    return found.withColumn("summary", F.coalesce("summary", F.concat(F.lit("Known vulnerability in "), "name"))).withColumn("url", F.concat(F.lit(ADVISORY_URL), "id"))


def by_severity(vulnerabilities: DataFrame) -> DataFrame:
    return vulnerabilities.orderBy(severity_rank(F.col("severity")), "repo", "ecosystem", "name", "version", "id")


def _finding(code: str, path, language: str, message, severity, suggestion, pattern):
    return [
        F.col("repo"), path.alias("path"), F.lit(language).alias("language"), F.lit(0).alias("line"), F.lit(0).alias("col"),
        F.lit(code).alias("code"), severity.cast("int").alias("severity"), F.lit(CATEGORY).alias("category"),
        message.alias("message"), suggestion.alias("suggestion"), pattern.alias("pattern"),
    ]


def audit_findings(audit: DataFrame) -> DataFrame:
    detail = F.when(F.col("url") != "", F.concat(F.lit(" Details: "), "url")).otherwise("")
    return audit.select(*_finding(
        "DEP-AUDIT", F.lit("package.json"), "json",
        F.concat(F.lit("Vulnerability in "), "name", F.lit(": "), "title", F.lit(" ("), "severity", F.lit(")")),
        F.when(F.col("severity").isin("critical", "high"), 2).when(F.col("severity") == "moderate", 1).otherwise(0),
        F.when(F.col("fix_available"), F.concat(F.lit("A fix is available: update "), "name", F.lit("."), detail))
        .otherwise(F.concat(F.lit("No automatic fix."), detail)),
        F.col("name"),
    ))


def outdated_findings(outdated: DataFrame) -> DataFrame:
    return outdated.select(*_finding(
        "DEP-OUTDATED", F.lit("package.json"), "json",
        F.concat("name", F.lit(" is outdated: "), "current", F.lit(" -> "), "latest", F.lit(" ("), "update_type", F.lit(" update)")),
        F.when(F.col("update_type") == "major", WARNING).otherwise(INFO),
        F.concat(F.lit("Update "), "name", F.lit(" to "), "latest"),
        F.col("name"),
    ))


def advisory_findings(vulnerabilities: DataFrame) -> DataFrame:
    return vulnerabilities.select(*_finding(
        "DEP-OSV", F.col("manifest"), "plaintext",
        F.concat("id", F.lit(": "), "name", F.lit("@"), "version", F.lit(" - "), "summary", F.lit(" ("), "severity", F.lit(")")),
        audit_severity(F.col("severity")),
        F.when(F.col("fixed_version").isNotNull(), F.concat(F.lit("Update "), "name", F.lit(" to "), "fixed_version", F.lit(" or later. Details: "), "url"))
        .otherwise(F.concat(F.lit("No fixed version listed. Details: "), "url")),
        F.col("name"),
    ))


def dependency_findings(audit: DataFrame, outdated: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """All dependency facts as findings at line 0 of their manifest."""
    return audit_findings(audit).unionByName(outdated_findings(outdated)).unionByName(advisory_findings(vulnerabilities))


def dependency_summary(audit: DataFrame, outdated: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """(repo, kind, key, n): audit by severity, outdated by update type, advisories by manifest."""
    parts = [(audit, "audit", "severity"), (outdated, "outdated", "update_type"), (vulnerabilities, "advisory", "manifest")]
    rows = [d.select("repo", F.lit(kind).alias("kind"), F.col(key).alias("key")) for d, kind, key in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("repo", "kind", "key").agg(F.count("*").alias("n"))


def stack_drift(current: DataFrame, latest: DataFrame) -> DataFrame:
    """Components (repo, component, current) against latest versions (component, latest).

    A version that differs without a readable number counts as a major update for Node.js, the one
    component whose installed version is known exactly.
    """
    joined = current.join(latest, "component", "left")
    change = update_type(F.col("current"), F.coalesce("latest", F.lit("")))
    differs = (F.col("component") == "Node.js") & (F.coalesce("latest", F.lit("")) != "") & (F.col("current") != F.col("latest"))
    return joined.select(
        "repo", "component", "current", "latest", ((change != "unknown") | differs).alias("is_outdated"),
        F.when(change != "unknown", change).when(differs, "major").otherwise("up-to-date").alias("update_type"),
    )
