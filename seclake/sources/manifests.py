"""Packages named in dependency manifests: a table (repo, dir, file, content) in, package rows out.

Each parser is one expression over the text of a manifest; sections and blocks are cut out by pattern
instead of being tracked line by line, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EVERYTHING = 1_000_000_000
PACKAGES = "array<struct<name:string,version:string>>"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _rows(items: Column, pattern: str, fix: Callable[[Column], Column] | None = None) -> Column:
    """array<struct(name, version)> from the items that match; groups 1 and 2."""

    def take(i: Column) -> Column:
        version = F.regexp_extract(i, pattern, 2)
        return F.struct(F.regexp_extract(i, pattern, 1).alias("name"), (fix(version) if fix else version).alias("version"))

    return F.transform(F.filter(items, lambda i: i.rlike(pattern)), take)


def _clean_lines(content: Column, comment: str) -> Column:
    return F.filter(
        F.transform(F.split(content, "\n"), lambda l: _strip(F.regexp_replace(l, comment, ""))), lambda l: l != ""
    )


def requirements_txt(content: Column) -> Column:
    pins = F.transform(
        F.filter(_clean_lines(content, "#.*$"), lambda l: ~l.startswith("-")),
        lambda l: _strip(F.substring_index(l, ";", 1)),
    )
    return _rows(pins, r"\A([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*==\s*([0-9][A-Za-z0-9.+!_-]*)\z")


def go_mod(content: Column) -> Column:
    text = F.array_join(_clean_lines(content, "//.*$"), "\n")
    block = r"(?ms)^require\s*\($(.*?)(?:^\)$|\z)"
    inside = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(block), F.lit(1)), lambda b: F.split(b, "\n")))
    outside = F.split(F.regexp_replace(text, block, ""), "\n")
    return F.concat(
        _rows(inside, r"\A(\S+)\s+v([0-9]\S*)\z"), _rows(outside, r"\Arequire\s+(\S+)\s+v([0-9]\S*)\z")
    )


def cargo_lock(content: Column) -> Column:
    blocks = F.slice(F.split(content, r"\[\[package\]\]"), F.lit(2), F.size(F.split(content, r"\[\[package\]\]")))
    pick = lambda key: rf'(?m)^\s*{key}\s*=\s*"([^"]+)"'
    named = F.filter(blocks, lambda b: b.rlike(pick("name")) & b.rlike(pick("version")))
    return F.transform(
        named,
        lambda b: F.struct(
            F.regexp_extract(b, pick("name"), 1).alias("name"), F.regexp_extract(b, pick("version"), 1).alias("version")
        ),
    )


def cargo_toml(content: Column) -> Column:
    text = F.concat(F.lit("\n"), F.array_join(_clean_lines(content, "#.*$"), "\n"))
    sections = F.filter(
        F.split(text, r"\n(?=\[[^\]]+\](?:\n|\z))"),
        lambda s: s.rlike(r"\A\[(?:workspace\.)?(?:dependencies|dev-dependencies|build-dependencies)\](?:\n|\z)"),
    )
    rows = F.flatten(F.transform(sections, lambda s: F.split(s, "\n")))
    bare = lambda v: F.regexp_replace(v, r"^[\^~=\s]+", "")
    plain = r'\A([A-Za-z0-9._-]+)\s*=\s*"([^"]+)"\z'
    inline = r'\A([A-Za-z0-9._-]+)\s*=\s*\{.*version\s*=\s*"([^"]+)".*\}\z'
    found = F.concat(_rows(rows, plain, bare), _rows(rows, inline, bare))
    return F.filter(found, lambda p: p["version"].rlike(r"\A\d+(\.\d+){0,2}([.+-][A-Za-z0-9.]+)?\z"))


def pom_xml(content: Column) -> Column:
    block = F.regexp_extract(content, r"(?s)<properties>(.*?)</properties>", 1)
    entry = F.lit(r"<([A-Za-z0-9._-]+)>([^<]+)</\1>")
    properties = F.arrays_zip(
        F.regexp_extract_all(block, entry, F.lit(1)).alias("name"),
        F.regexp_extract_all(block, entry, F.lit(2)).alias("value"),
    )
    wanted = F.regexp_extract_all(content, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))

    def tag(d: Column, name: str) -> Column:
        return F.regexp_extract(d, rf"<{name}>([^<]+)</{name}>", 1)

    def package(d: Column) -> Column:
        version = F.trim(tag(d, "version"))
        reference = F.regexp_extract(version, r"\A\$\{([^}]+)\}\z", 1)
        resolved = F.trim(F.try_element_at(F.filter(properties, lambda p: p["name"] == reference), F.lit(-1))["value"])
        return F.struct(
            F.concat(F.trim(tag(d, "groupId")), F.lit(":"), F.trim(tag(d, "artifactId"))).alias("name"),
            F.when(reference != "", resolved).otherwise(version).alias("version"),
        )

    whole = F.filter(wanted, lambda d: (tag(d, "groupId") != "") & (tag(d, "artifactId") != "") & (tag(d, "version") != ""))
    return F.filter(F.transform(whole, package), lambda p: F.coalesce(p["version"].rlike(r"\A\d"), F.lit(False)))


def gemfile_lock(content: Column) -> Column:
    sections = F.filter(F.split(content, r"\n(?=[A-Z])"), lambda s: s.rlike(r"\AGEM\s*(?:\n|\z)"))
    specs = F.transform(
        sections, lambda s: F.regexp_extract(s, r"(?s)\A[^\n]*\n(?:.*?\n)??[ \t]*specs:[ \t\r]*\n(.*)\z", 1)
    )
    rows = F.flatten(F.transform(specs, lambda s: F.split(s, "\n")))
    return _rows(rows, r"\A    ([A-Za-z0-9._-]+) \(([0-9][A-Za-z0-9.]*)")


def composer_lock(content: Column) -> Column:
    doc = F.from_json(content, f"packages {PACKAGES}, `packages-dev` {PACKAGES}")
    none = F.expr("array()").cast(PACKAGES)
    both = F.concat(F.coalesce(doc["packages"], none), F.coalesce(doc["packages-dev"], none))
    return F.transform(
        F.filter(both, lambda p: p["name"].isNotNull() & p["version"].isNotNull()),
        lambda p: F.struct(p["name"].alias("name"), F.regexp_replace(p["version"], "^v", "").alias("version")),
    )


# File, ecosystem, and the sibling that takes its place, in order of preference.
MANIFESTS: list[tuple[str, str, Callable[[Column], Column], str | None]] = [
    ("requirements.txt", "PyPI", requirements_txt, None),
    ("go.mod", "Go", go_mod, None),
    ("Cargo.lock", "crates.io", cargo_lock, None),
    ("Cargo.toml", "crates.io", cargo_toml, "Cargo.lock"),
    ("pom.xml", "Maven", pom_xml, None),
    ("Gemfile.lock", "RubyGems", gemfile_lock, None),
    ("composer.lock", "Packagist", composer_lock, None),
]


def preferred_manifests(manifests: DataFrame) -> DataFrame:
    """Known manifests, without those whose lock file lies next to them."""
    known = manifests.where(F.col("file").isin([m[0] for m in MANIFESTS]))
    for file, _, _, better in MANIFESTS:
        if better:
            lock = known.where(F.col("file") == better).select("repo", "dir", F.lit(file).alias("file")).distinct()
            known = known.join(lock, ["repo", "dir", "file"], "left_anti")
    return known


def manifest_errors(manifests: DataFrame) -> DataFrame:
    """Manifests that could not be read; the others are still used."""
    broken_json = (F.col("file") == "composer.lock") & F.from_json("content", "map<string,string>").isNull()
    return preferred_manifests(manifests).where(F.col("content").isNull() | broken_json).select("repo", "dir", "file")


def package_rows(manifests: DataFrame) -> DataFrame:
    """Every package reference: (repo, dir, manifest, ecosystem, name, version)."""
    known = preferred_manifests(manifests)
    found, eco = None, None
    for file, ecosystem, parse, _ in MANIFESTS:
        is_file = F.col("file") == file
        rows = parse(F.col("content")).cast(PACKAGES)
        found = F.when(is_file, rows) if found is None else found.when(is_file, rows)
        eco = F.when(is_file, ecosystem) if eco is None else eco.when(is_file, ecosystem)
    return known.select(
        "repo", "dir", F.col("file").alias("manifest"), eco.alias("ecosystem"), F.explode(found).alias("p")
    ).select("repo", "dir", "manifest", "ecosystem", "p.name", "p.version")


def packages(manifests: DataFrame) -> DataFrame:
    """One row per (repo, dir, ecosystem, name, version): the first manifest that names it."""
    rank = F.when(F.col("manifest") == MANIFESTS[0][0], 0)
    for i, m in enumerate(MANIFESTS[1:], 1):
        rank = rank.when(F.col("manifest") == m[0], i)
    return (
        package_rows(manifests)
        .groupBy("repo", "dir", "ecosystem", "name", "version")
        .agg(F.min_by("manifest", rank).alias("manifest"))
    )
