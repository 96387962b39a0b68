"""Text files as a table (repo, path, language, content), and which of them to scan."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import any_of
from ..functions.literals import required
from ..plans.workspace import can_store, listed, written
from ..rules.model import Rx, rx

# What is scanned, what is skipped, and the language of each extension.
EXTENSIONS = [
    "js", "jsx", "mjs", "cjs", "ts", "tsx", "py", "java", "cs", "php", "go", "rs", "kt", "kts",
    "yaml", "yml", "tf", "tfvars", "hcl",
]
FILE_NAMES = ["Dockerfile", "dockerfile", "Containerfile"]
SKIPPED_FOLDERS = [
    "node_modules", ".git", "dist", "build", "out", "coverage", ".next", ".nuxt", "vendor",
    "__pycache__", "target",
]
EXTENSION_LANGUAGE = {
    "js": "javascript", "jsx": "javascriptreact", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescriptreact", "py": "python", "java": "java", "cs": "csharp",
    "php": "php", "go": "go", "rs": "rust", "kt": "kotlin", "kts": "kotlin", "yaml": "yaml",
    "yml": "yaml", "tf": "terraform", "tfvars": "terraform", "hcl": "terraform",
}
EDITOR_LANGUAGES = {
    "javascript": ["js", "jsx", "mjs", "cjs"], "typescript": ["ts", "tsx", "mts", "cts"],
    "python": ["py"], "java": ["java"], "csharp": ["cs"], "php": ["php"], "go": ["go"],
    "rust": ["rs"], "kotlin": ["kt", "kts"],
}
MAX_FILE_SIZE = 500_000

# Traces of generated files in a path and in the first 500 characters.
GENERATED_PATHS = [
    r"/generated/", r"\.generated\.", r"-generated\.", r"\.min\.\w+$", r"\.bundle\.(?:js|mjs|cjs)$",
    r"\.chunk\.(?:js|mjs|cjs)$", r"/dist/", r"/build/", r"/out/", r"/target/", r"/__generated__/",
    r"/\.next/", r"/\.nuxt/", r"/vendor/", r"/third.?party/", r"workbox-.*\.js$", r"sw\.js$",
    r"service-?worker\.js$",
]
GENERATED_MARKS = [
    r"@generated", r"@auto-generated", r"@autogenerated", r"automatically generated", r"do not edit",
    r"code generator", r"this file is generated", r"generated by \w+", r"GENERATED CODE",
    r"AUTO-GENERATED", r"apollo.*codegen", r"graphql.*generator", r"protocol buffer compiler",
    r"protoc.*generated", r"swagger.*codegen", r"openapi.*generator", r"typescript.*compiler",
    r"webpack", r"rollup", r"parcel",
]
MINIFIED_SHAPES = [r";[a-z]=function\(", r"\}\([a-z0-9,]{10,}\)", r"var [a-z]=[a-z],"]


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1))


def language(path: Column) -> Column:
    """By file name, else by extension, else the extension itself."""
    known = F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv])
    ext = extension(path)
    return F.when(base_name(path).isin(FILE_NAMES), F.lit("dockerfile")).otherwise(
        F.coalesce(F.try_element_at(known, ext), ext)
    )


def eligible(path: Column, excludes: Sequence[str] = (), includes: Sequence[str] = ()) -> Column:
    folders = F.split(path, "/")
    folders = F.slice(folders, F.lit(1), F.size(folders) - 1)
    skipped = F.array(*[F.lit(x) for x in [*SKIPPED_FOLDERS, *excludes]])
    wanted = extension(path).isin(EXTENSIONS) | base_name(path).isin(FILE_NAMES)
    for part in includes:
        wanted = wanted | path.contains(part)
    return wanted & ~F.arrays_overlap(folders, skipped)


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)"


def listed_path(root: str) -> Column:
    """The path of a file below a folder, from the listing alone."""
    # The listing has URLs, where a plus sign stands for itself.
    whole = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), _SCHEME, "")
    base = re.sub(_SCHEME, "", root).rstrip("/")
    start = F.lit(len(base) + 2) if base.startswith("/") or not base else F.instr(whole, f"/{base}/") + len(base) + 2
    return F.substring(whole, start, F.length(whole))


_FILE_SCHEME = r"^file:(?://[^/]*)?(?=/)"


def _local_folder(spark: SparkSession, root: str) -> str | None:
    """The path of a folder that all machines have in their file system; null for other stores, patterns and files."""
    bare = re.sub(_FILE_SCHEME, "", root)
    store = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    plain = bare.startswith("/") and (bare != root or store.startswith("file:")) and not re.search(r"[\[\]{}*?\\]", bare)
    return bare.rstrip("/") or "/" if plain and os.path.isdir(bare) else None


def _hidden(name: str) -> bool:
    """What Spark's readers pass over."""
    return (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)) and not name.startswith(("_metadata", "_common_metadata"))


def _folders_below(folder: str) -> list[str]:
    with os.scandir(folder) as entries:
        return [e.path for e in entries if not _hidden(e.name) and e.is_dir()]


def local_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path below the folder, size, mtime) of the files that Spark's readers would read, listed by the tasks.

    The driver looks at folders only, and only at as many as there is work for; below those a task walks.
    """
    many = 4 * spark.sparkContext.defaultParallelism
    flat, deep = [], [folder]
    while deep and len(deep) < many:
        flat, deep = flat + deep, [below for f in deep for below in _folders_below(f)]
    start = len(folder.rstrip("/")) + 1

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files_of(place: str, walked: bool) -> Iterator[tuple[str, int, int]]:
            left = [place]
            while left:
                with os.scandir(left.pop()) as entries:
                    for e in entries:
                        if _hidden(e.name):
                            continue
                        if e.is_dir():
                            if walked:
                                left.append(e.path)
                        elif e.is_file() and (told := e.stat()).st_size:
                            yield e.path[start:], told.st_size, told.st_mtime_ns // 1_000_000 * 1000

        def batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
            paths, sizes, times = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(times, pa.timestamp("us", "UTC"))], names=["path", "size", "mtime"])

        rows = []
        for row in (row for b in batches for f in b.to_pylist() for row in files_of(f["folder"], f["walked"])):
            rows.append(row)
            if len(rows) >= 10_000:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    folders = [(f, False) for f in flat] + [(f, True) for f in deep]
    return listed(spark, folders, "folder string, walked boolean").mapInArrow(walk, "path string, size long, mtime timestamp")


def local_content(folder: str, path: Column, size: Column, most: int, slice_bytes: int = 8 << 20) -> Column:
    """The bytes of a listed file. A file beyond `most` bytes ends the query if it is read at all."""
    @F.pandas_udf("binary")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for paths, sizes in batches:
            contents, held = [], 0
            for at, length in zip(paths, sizes, strict=True):
                if length > most:
                    raise ValueError(f"{folder}/{at} has {length} bytes, the limit of spark.sql.sources.binaryFile.maxLength is {most}")
                with open(f"{folder}/{at}", "rb") as file:
                    contents.append(file.read())
                held += length
                if held >= slice_bytes:
                    yield pd.Series(contents, dtype=object)
                    contents, held = [], 0
            if contents:
                yield pd.Series(contents, dtype=object)

    return read(path, size)


def read_files(
    spark: SparkSession, root: str, repo: str, excludes: Sequence[str] = (), includes: Sequence[str] = (), max_size: int | None = None,
    path_glob: str | None = None, task_bytes: int = 16 << 20,
) -> DataFrame:
    """Files below a folder, one row each. Paths are relative to the folder.

    Which files to read is decided on the listing: path, language and size come from it, and tests on them, those here and
    the caller's own on top, leave files out before they are opened. Bytes that are not UTF-8 become replacement characters.

    Folders in the file system of the machines are listed by tasks, the listing is stored, and the files are dealt over tasks of about `task_bytes`.
    Other stores go through Spark's reader, whose listing is held by the driver, and whose splits, some thirty files each, are joined to such tasks.
    """
    folder = None if path_glob or not can_store(spark) else _local_folder(spark, root)
    if folder:
        raw, path, size, mtime = local_listing(spark, folder), F.col("path"), F.col("size"), F.col("mtime")
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        raw = (reader.option("pathGlobFilter", path_glob) if path_glob else reader).load(root)
        path, size, mtime = listed_path(root), F.col("_metadata.file_size"), F.col("_metadata.file_modification_time")
    raw = raw.where(eligible(path, excludes, includes))
    if max_size:
        raw = raw.where(size <= max_size)
    least = 4 * spark.sparkContext.defaultParallelism
    if folder:
        raw = written(raw)
        tasks = max(least, -(-(raw.agg(F.sum(size)).first()[0] or 0) // task_bytes))
        raw = raw.repartition(tasks)
        most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str((1 << 31) - 1)))
        content = local_content(folder, path, size, most)
    else:
        tasks = max(least, -(-raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() // task_bytes))
        content = F.col("content")
    rows = raw.select(
        F.lit(repo).alias("repo"), path.alias("path"), language(path).alias("language"),
        F.make_valid_utf8(content.cast("string")).alias("content"), size.alias("size"), mtime.alias("mtime"),
    )
    return rows if folder else rows.coalesce(tasks)


def write_files(rows: DataFrame, folder: str, folder_files: int = 1000) -> int:
    """Store each row (name, content) as a file of its own below the folder, and count them.

    The tasks write the files where they are to stay, some to a folder: a path is `part-<task>-<folder>/<row>-<name>`. A folder for
    each file, or files that are moved when all are written, would take a listing or a step of the driver for each of them. The
    folder is an absolute path or a URL that Arrow knows (file, hdfs, s3, gs, abfs).
    """
    def store(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        local = re.sub(r"^file:(?://[^/]*)?", "", folder)
        place, root = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(folder)
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            names, contents = batch.column(0), batch.column(1).cast(pa.large_binary())
            for name, content in zip(names, contents, strict=True):
                below = f"{root}/part-{task:06d}-{row // folder_files:06d}"
                if row % folder_files == 0:
                    place.create_dir(below)
                with place.open_output_stream(f"{below}/{row}-{name.as_py()}") as out:
                    out.write(content.as_py() or b"")
                row += 1
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64())], names=["files"])

    return rows.select("name", "content").mapInArrow(store, "files long").agg(F.sum("files")).first()[0] or 0


def tasks_wanted(table: DataFrame, task_bytes: int = 16 << 20) -> int | None:
    """Over how many tasks to deal a stored table so that none has more than about `task_bytes` of text; null where its splits do.

    Scanning text is bound by computing, so a small table in one split would leave cores idle. Splits are made by the bytes of
    compressed files, so that the text in one of them is without a bound: the texts are measured, and a table with too few splits
    for them is to be dealt over as many tasks as they need.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    splits = table.rdd.getNumPartitions()
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)).cast("long") for f in table.schema if f.dataType.simpleString() == "string"]
    held = table.agg(F.sum(reduce(Column.__add__, texts))).first()[0] or 0 if texts else 0
    wanted = -(-held // task_bytes)
    return None if splits >= max(cores, wanted) else max(4 * cores, wanted)


def spread(table: DataFrame, task_bytes: int = 16 << 20) -> DataFrame:
    """Spread a stored table over tasks of at most about `task_bytes` of text, and over the cores when it has fewer splits than cores.

    One with enough splits is left alone: nothing is shuffled. Call it on a plain read.
    The (always true) row-number test keeps later filters from being moved below the exchange, where
    they would run on the few cores again.
    """
    tasks = tasks_wanted(table, task_bytes)
    return table.repartition(tasks).where(F.monotonically_increasing_id() >= 0) if tasks else table


@dataclass(frozen=True)
class Limits:
    """What a scan leaves out. Nothing, unless asked for."""

    file_bytes: int | None = None
    line_chars: int | None = None
    skip_generated: bool = False
    skip_minified: bool = False
    function_lines: int | None = None
    variables: int | None = None
    reminder_lines: int | None = None


NO_LIMITS = Limits()
#: The limits of an interactive scan, for those who want the same findings in bulk.
INTERACTIVE_LIMITS = Limits(MAX_FILE_SIZE, 2000, True, True, 200, 50, 10)


def within_size(content: Column, limit: int | None = MAX_FILE_SIZE, unit: str = "bytes") -> Column:
    """Size guard; 0 or None switches it off. `unit` is bytes (command line) or characters (editor)."""
    if not limit:
        return F.lit(True)
    return (F.octet_length(content) if unit == "bytes" else F.length(content)) <= limit


def generated_by_path(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/")).rlike("|".join(f"(?:{p})" for p in GENERATED_PATHS))


def _matches_any(text: Column, patterns: list[Rx]) -> Column:
    """One expression for all patterns, run only on text that holds a string one of them needs.

    Plain substring tests are far cheaper than the alternation, and nearly every file fails them.
    """
    words = sorted(set().union(*[required(p) for p in patterns]))
    low = F.lower(text)
    possible = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return F.when(possible, text.rlike(any_of(patterns))).otherwise(F.lit(False))


def generated_by_content(content: Column) -> Column:
    return _matches_any(F.substring(content, 1, 500), [rx(p, "i") for p in GENERATED_MARKS])


def minified(content: Column) -> Column:
    sample = F.substring(content, 1, 1000)
    breaks = F.length(sample) - F.length(F.replace(sample, F.lit("\n"), F.lit("")))
    return F.when(breaks == 0, F.length(sample) > 500).otherwise(
        (F.length(sample) / (breaks + 1) > 300) | _matches_any(sample, [rx(p) for p in MINIFIED_SHAPES])
    )


def skip_reason(path: Column, content: Column, limits: Limits = INTERACTIVE_LIMITS) -> Column:
    """Why a file is left out, or null: size, generated or minified, in this order."""
    tests = [F.when(~within_size(content, limits.file_bytes), "size")] if limits.file_bytes else []
    if limits.skip_generated:
        tests.append(F.when(generated_by_path(path) | generated_by_content(content), "generated"))
    if limits.skip_minified:
        tests.append(F.when(minified(content), "minified"))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def scannable(path: Column, content: Column, limits: Limits = INTERACTIVE_LIMITS) -> Column:
    return skip_reason(path, content, limits).isNull()


def skipped(files: DataFrame, limits: Limits = INTERACTIVE_LIMITS) -> DataFrame:
    """What the limits leave out: (repo, path, line, reason). A null line stands for the whole file."""
    judged = files.select("repo", "path", "content", skip_reason(F.col("path"), F.col("content"), limits).alias("reason"))
    whole = judged.where(F.col("reason").isNotNull()).select("repo", "path", F.lit(None).cast("int").alias("line"), "reason")
    if not limits.line_chars:
        return whole
    kept = judged.where(F.col("reason").isNull() & (F.length("content") > limits.line_chars))
    long = kept.select("repo", "path", F.posexplode(F.split("content", "\n")).alias("line", "text")).where(F.length("text") > limits.line_chars)
    return whole.unionByName(long.select("repo", "path", "line", F.lit("line length").alias("reason")))


def lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 0."""
    kept = [c for c in files.columns if c != "content"]
    return files.select(*kept, F.posexplode(F.split("content", "\n")).alias("line", "text"))


def short_lines(numbered: DataFrame, limit: int = 2000) -> DataFrame:
    return numbered.where(F.length("text") <= limit)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def file_snapshot(files: DataFrame, scanned_at: Column) -> DataFrame:
    """State to keep for the next run. Matched text is left out on purpose."""
    return files.select(
        "repo", "path", "language", F.octet_length("content").alias("size"), "mtime",
        content_hash(F.col("content")).alias("content_hash"), scanned_at.alias("scanned_at"),
    )


def file_changes(files: DataFrame, state: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """new, modified, unchanged or deleted, per path.

    Sizes and times decide most files, and come from the listing where `files` has them. Only contents of equal size and another
    time are hashed, in the row of their file: the list of these paths goes to the files if it has at most `most_bytes`; beyond
    that every file is hashed. What is shuffled are listings and hashes, no contents.
    """
    old = state.select("repo", "path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("content_hash").alias("old_hash"))
    size = F.col("size") if "size" in files.columns else F.octet_length("content")
    now = files.select("repo", "path", size.alias("size"), "mtime")
    same_size = F.col("size") == F.col("old_size")
    status = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("size").isNull(), "deleted")
        .when(same_size & (F.col("mtime") == F.col("old_mtime")), "unchanged")
        .when(~same_size, "modified")
    )
    decided = written(now.join(old, ["repo", "path"], "full_outer").select("repo", "path", status.alias("status"), "old_hash"))
    unsettled = decided.where(F.col("status").isNull()).select("repo", "path", "old_hash")
    listed = unsettled.agg(F.coalesce(F.sum(F.octet_length("repo") + F.octet_length("path") + 100), F.lit(0))).first()[0]
    if listed <= most_bytes:
        read = files.select("repo", "path", "content").join(F.broadcast(unsettled), ["repo", "path"])
        hashed = read.select("repo", "path", "old_hash", content_hash(F.col("content")).alias("hash"))
    else:
        hashed = files.select("repo", "path", content_hash(F.col("content")).alias("hash")).join(unsettled, ["repo", "path"])
    settled = hashed.select("repo", "path", F.when(F.col("hash") == F.col("old_hash"), "unchanged").otherwise("modified").alias("status"))
    return decided.where(F.col("status").isNotNull()).select("repo", "path", "status").unionByName(settled)
