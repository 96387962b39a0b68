"""The function around a finding and where the names on its line are defined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.dialect import java_regex
from ..rules.model import rx
from .joining import meet
from .matching import FILE, split_lines
from .taint import function_ranges

BLOCK_LINES = 200
_IDENTIFIER = rx(r"\b([a-zA-Z_$][\w$]*)\b")

# Words that are not identifiers.
KEYWORDS = (
    "const let var function return if else for while do switch case break continue new this class import export "
    "from default async await try catch throw typeof instanceof void delete in of true false null undefined yield "
    "super extends implements interface type enum public private protected static readonly abstract as is keyof "
    "never unknown any string number boolean object symbol bigint"
).split()


def identifiers(text: Column) -> Column:
    """Distinct names of at least two characters, without keywords, in order of appearance."""
    words = F.regexp_extract_all(text, F.lit(java_regex(_IDENTIFIER)), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(KEYWORDS)))


def parameters(declaration: Column) -> Column:
    """Names inside the first pair of brackets."""
    inside = F.regexp_extract(declaration, r"(?s)\A[^(]*\(([^)]*)\)", 1)
    names = F.transform(F.split(inside, ","), lambda p: F.regexp_extract(F.trim(p), r"^(\w+)", 1))
    return F.filter(names, lambda n: n != "")


def functions(files: DataFrame) -> DataFrame:
    """(file, start, stop) of every function."""
    held = files.select(*FILE, split_lines(F.col("content")).alias("lines"))
    ranges = held.select(*FILE, function_ranges(F.col("lines")).alias("r"))
    return ranges.select(*FILE, F.explode("r").alias("r")).select(*FILE, "r.start", "r.stop")


def enclosing_functions(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with the innermost function around them (start and stop null outside any).

    Joining on (file, block of lines) meets a line with the functions that reach its block only.
    """
    block = lambda line: F.floor(line / BLOCK_LINES)
    places = findings.select("repo", "path", "line").distinct().withColumn("block", block(F.col("line")))
    ranges = functions(files).select(
        "repo", "path", "start", "stop", F.explode(F.sequence(block(F.col("start")), block(F.col("stop")))).alias("block")
    )
    inside = places.join(ranges, ["repo", "path", "block"]).where(F.col("line").between(F.col("start"), F.col("stop")))
    innermost = inside.groupBy("repo", "path", "line").agg(
        F.max(F.struct("start", (-F.col("stop")).alias("s"))).alias("f")
    )
    return findings.join(innermost, ["repo", "path", "line"], "left").select(
        *findings.columns, F.col("f.start").alias("start"), (-F.col("f.s")).alias("stop")
    )


def _definitions(lines: Column, ranges: Column, at: Column) -> Column:
    """array<struct(line, name, kind, i, text)>: what each line `at` names and where its function defines it; `i` counts from the head."""

    def named(body: Column, facts: Column, place: Column, name: Column) -> Column:
        quoted = F.replace(name, F.lit("$"), F.lit(r"\$"))
        declares = F.concat(F.lit(r"(?:const|let|var)\s+"), quoted, F.lit(r"(?!\w)"))
        sets = F.concat(declares, F.lit(r"|(?<!\w)"), quoted, F.lit(r"\s*="))
        before = F.try_element_at(F.filter(facts, lambda b: (b["i"] < place) & F.rlike(b["text"], sets)), F.lit(-1))
        after = F.get(F.filter(facts, lambda b: (b["i"] > place) & F.rlike(b["text"], declares)), F.lit(0))
        told = lambda kind, i, text: F.struct(F.lit(kind).alias("kind"), i.alias("i"), text.alias("text"))
        head = F.get(body, F.lit(0))
        return (
            F.when(F.array_contains(parameters(head), name), told("parameter", F.lit(0), head))
            .when(before.isNotNull(), told("before", before["i"], before["text"])).when(after.isNotNull(), told("after", after["i"], after["text"]))
        )

    def inside(line: Column, start: Column, body: Column) -> Column:
        # Lines that may define something, once for all names.
        facts = F.filter(F.transform(body, lambda t, i: F.struct(i.alias("i"), t.alias("text"))), lambda b: F.rlike(b["text"], F.lit(r"=|(?:const|let|var)\s")))
        row = lambda name, d: F.when(d.isNotNull(), F.struct(line.alias("line"), name.alias("name"), d["kind"].alias("kind"), (start + d["i"]).alias("definition_line"), d["text"].alias("text")))
        found = lambda f: F.transform(identifiers(F.get(lines, line)), lambda name: let(named(body, f, line - start, name), lambda d: row(name, d)))
        return F.filter(let(facts, found), lambda d: d.isNotNull())

    def one(line: Column) -> Column:
        around = F.transform(F.filter(ranges, lambda r: (r["start"] <= line) & (line <= r["stop"])), lambda r: F.struct(r["start"].alias("start"), (-r["stop"]).alias("stop")))
        return let(F.array_max(around), lambda r: F.when(r.isNotNull(), let(F.slice(lines, r["start"] + 1, -r["stop"] - r["start"] + 1), lambda body: inside(line, r["start"], body))))

    return F.flatten(F.filter(F.transform(at, one), lambda d: d.isNotNull()))


def definitions(findings: DataFrame, files: DataFrame) -> DataFrame:
    """For each name on a finding's line: the parameter list, else the nearest earlier line that sets it,
    else the first later line that declares it, all within the enclosing function.

    The lines to look at go to the files, as long as they are few enough (see `joining.meet`); everything else happens inside the row of
    a file, and only definitions leave it.
    """
    places = findings.groupBy("repo", "path").agg(F.array_sort(F.collect_set("line")).alias("at"))
    held = meet(files.select(*FILE, "content"), places, ["repo", "path"]).withColumn("lines", split_lines(F.col("content")))
    held = held.select(*FILE, "lines", "at", function_ranges(F.col("lines")).alias("ranges"))
    found = held.select("repo", "path", F.explode(_definitions(F.col("lines"), F.col("ranges"), F.col("at"))).alias("d"))
    told = found.select("repo", "path", "d.line", "d.name", "d.kind", "d.definition_line", F.trim("d.text").alias("definition_text"))
    return findings.select(*FILE, "line", "code").join(told, ["repo", "path", "line"]).select(*FILE, "line", "code", "name", "kind", "definition_line", "definition_text")
