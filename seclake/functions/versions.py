"""Version numbers and advisory severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.model import ERROR, INFO, WARNING


def semver(version: Column) -> Column:
    """array(major, minor, patch), or null."""
    pattern = r"^[v^~>=<\s]*(\d+)\.(\d+)\.(\d+)"
    parts = F.array(*[F.regexp_extract(version, pattern, i).cast("bigint") for i in (1, 2, 3)])
    return F.when(version.rlike(pattern), parts)


def update_type(current: Column, latest: Column) -> Column:
    a, b = semver(current), semver(latest)
    return (
        F.when(a.isNull() | b.isNull(), "unknown")
        .when(a[0] != b[0], "major")
        .when(a[1] != b[1], "minor")
        .when(a[2] != b[2], "patch")
        .otherwise("unknown")
    )


def _number(digits: Column) -> Column:
    """Digits so that text order is the order of the numbers: how many there are, then themselves, without leading zeros."""
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 4, "0"), plain)


def version_key(version: Column) -> Column:
    """A text whose byte order is the order of versions, parsed once: all numeric parts, then development and pre-releases before
    the release and post-releases after it, each by its words and numbers. Build metadata after `+` does not count. Null
    if there is no number in front."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(version, r"^[v=\s]+", ""), r"\+.*$", ""))
    core = F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)*)", 1)
    trimmed = F.regexp_replace(core, r"(?:\.0+)+$", "")  # 1.2 and 1.2.0 are equal
    parts = F.transform(F.split(trimmed, r"\."), _number)
    rest = F.substring(clean, F.length(core) + 1, F.length(clean))
    words = F.regexp_extract_all(rest, F.lit("[0-9]+|[a-z]+"), F.lit(0))
    # Numbers come before words, and by value; what ends a word sorts before its letters.
    order = F.transform(words, lambda w: F.when(w.rlike("^[0-9]"), F.concat(F.lit("0"), _number(w))).otherwise(F.concat(F.lit("1"), w, F.lit("!"))))
    first = F.get(words, F.lit(0))
    stage = (
        F.when(F.size(words) == 0, "2").when(first.isin("post", "rev", "r", "sp", "patch"), "3").when(first == "dev", "0")
        .when(first.isin("final", "ga", "release"), "2").otherwise("1")
    )
    # Fewer parts sort first: what ends them sorts before any digit.
    return F.when(core != "", F.concat(F.array_join(parts, ""), F.lit("!"), stage, F.when(stage == "2", "").otherwise(F.array_join(order, ""))))


def in_range(version: Column, introduced: Column, fixed: Column, last_affected: Column | None = None) -> Column:
    """introduced <= version, and version < fixed or version <= last_affected; "0" or null opens the lower end, nulls the upper."""
    v = version_key(version)
    low = introduced.isNull() | (introduced == "0") | (v >= version_key(introduced))
    high = fixed.isNull() | (v < version_key(fixed))
    if last_affected is not None:
        high = F.when(fixed.isNotNull(), v < version_key(fixed)).otherwise(last_affected.isNull() | (v <= version_key(last_affected)))
    return low & high


def package_name(name: Column, ecosystem: Column) -> Column:
    """The form in which names are compared: PyPI takes case, `-`, `_` and `.` as equal."""
    return F.when(ecosystem == "PyPI", F.lower(F.regexp_replace(name, "[-_.]+", "-"))).otherwise(name)


def audit_severity(severity: Column) -> Column:
    """Severity of a finding for an advisory severity; unknown counts as moderate."""
    return (
        F.when(severity.isin("critical", "high"), ERROR)
        .when(severity.isin("moderate", "unknown"), WARNING)
        .otherwise(INFO)
    )


def advisory_severity(stated: Column, scores: Column) -> Column:
    """The stated level, else a guess from the first CVSS vector in `scores` (array of text)."""
    level = F.upper(stated)
    vector = F.get(F.filter(scores, lambda s: s.startswith("CVSS:")), F.lit(0))
    strong, remote = vector.rlike(r"/(C|I|A):H"), vector.rlike("AV:N")
    return (
        F.when(level == "CRITICAL", "critical").when(level == "HIGH", "high")
        .when(level.isin("MODERATE", "MEDIUM"), "moderate").when(level == "LOW", "low")
        .when(vector.isNull(), "unknown").when(strong & remote, "high")
        .when(strong | remote, "moderate").otherwise("low")
    )


def severity_rank(severity: Column) -> Column:
    order = ["critical", "high", "moderate", "low"]
    chain = F.when(severity == order[0], 0)
    for i, s in enumerate(order[1:], 1):
        chain = chain.when(severity == s, i)
    return chain.otherwise(len(order))


def version_range(r: Column) -> Column:
    """Whether a range counts versions; ranges of commits do not."""
    return F.coalesce(F.upper(r["type"]), F.lit("ECOSYSTEM")) != "GIT"


def first_fixed(affected: Column, name: Column, ecosystem: Column) -> Column:
    """First fixed version the advisory lists for the package."""
    own = F.filter(
        affected,
        lambda a: (package_name(a["package"]["name"], a["package"]["ecosystem"]) == package_name(name, ecosystem)) & (a["package"]["ecosystem"] == ecosystem),
    )
    ranges = F.flatten(F.transform(own, lambda a: F.coalesce(F.filter(a["ranges"], version_range), F.expr("array()").cast(
        "array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>"))))
    events = F.flatten(F.transform(ranges, lambda r: r["events"]))
    return F.get(F.filter(F.transform(events, lambda e: e["fixed"]), lambda f: f.isNotNull()), F.lit(0))
