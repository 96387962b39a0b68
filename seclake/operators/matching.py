"""Rule matching: texts in, findings out.

A rule fires at most once per line, at the first of its patterns that survives every condition.
The plan never crosses lines with rules: a one-pass prefilter, shared with the flow analysis where a scan runs both, names the (line, pattern) pairs that are
possible, those few are joined with the (fixed-size) pattern table, and each pattern runs as a column
expression. Sorting the pairs by pattern inside each partition keeps one compiled expression in use
at a time. Neighbouring lines come from the text itself, so the match needs no shuffle; the only
exchange moves surviving hits, not text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.context import inside_comment, inside_markup_text, inside_string, line_states
from ..functions.dialect import any_of, java_regex, linear_guard
from ..functions.prefilter import FlowPatterns, candidate_flag, candidate_line, candidate_number, candidates_and_functions, line_candidates
from ..plans.workspace import listed
from ..rules import CATEGORY_LABELS, Rule
from ..rules.model import ADVISORY, CODE, REMINDER, Pattern

REACH = 3

FILE = ["repo", "path", "language"]
FINDING = [
    *FILE, "line", "col", "code", "severity", "category", "message", "suggestion", "pattern",
]

# What marks a line as a declaration, as a function body, as a call.
_DECLARES = (
    r"^\s*(?:import\s|export\s(?:type|interface|default)|const\s|let\s|var\s|type\s|interface\s|class\s)"
)
_BODY = r"(?:function\s|=>\s*\{|\.(?:then|catch|map|forEach|filter|reduce)\s*\()"
_CALL = r"\w+\s*\("

_PATTERN_TABLE = T.StructType([
    T.StructField("number", T.IntegerType()),
    T.StructField("rule", T.IntegerType()),
    T.StructField("code", T.StringType()),
    T.StructField("severity", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("suggestion", T.StringType()),
    T.StructField("literal", T.StringType()),
    T.StructField("regex", T.StringType()),
    T.StructField("unless", T.StringType()),
    T.StructField("unless_near", T.StringType()),
    T.StructField("only_paths", T.StringType()),
    T.StructField("skip_paths", T.StringType()),
    T.StructField("info_paths", T.StringType()),
    T.StructField("code_only", T.BooleanType()),
    T.StructField("guard", T.StringType()),
])


@dataclass(frozen=True)
class Companion:
    """Another analysis that shares a scan's pass over the texts.

    `hits` makes array<struct(line, which, told)> of a file's lines, its candidates of the companion's patterns and its functions.
    `rows` say by `which` what a hit is: (code, severity, category, what, suggestion, pattern). `message` puts `what` and `told` in words.
    """

    patterns: list[Pattern]
    flags: list[int]
    most_lines: int | None
    rows: list[tuple[str, int, str, str, str, str]]
    hits: Callable[[Column, Column, Column], Column]
    message: Callable[[Column, Column], Column]


def pattern_table(spark: SparkSession, rules: Sequence[Rule], companion: Companion | None = None, markers: bool = False) -> DataFrame:
    """One row per pattern; `number` orders patterns by rule, then by place within the rule. What a companion finds has no regex.

    With `markers` there is a row without a code, too, which each file meets once.
    """
    rows = []
    for place, r in enumerate(rules):
        for p in r.match:
            rows.append((
                len(rows), place, r.code, r.severity, r.category, r.kind, r.message, r.suggestion,
                p if isinstance(p, str) else None, java_regex(p), any_of(r.unless),
                any_of(r.unless_near), any_of(r.only_paths), any_of(r.skip_paths),
                any_of(r.info_paths), r.code_only, linear_guard(p),
            ))
    for which, (code, severity, category, what, suggestion, pattern) in enumerate(companion.rows if companion else ()):
        rows.append((len(rows), len(rules) + which, code, severity, category, CODE, what, suggestion, pattern, *[None] * 6, False, None))
    if markers:
        rows.append((_MARKER, _MARKER, *[None] * 13, False, None))
    return listed(spark, rows, _PATTERN_TABLE)


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [
        (i, r.code, r.message, r.severity, r.category, CATEGORY_LABELS.get(r.category, r.category),
         r.kind, r.suggestion, r.code_only, len(r.match))
        for i, r in enumerate(rules)
    ]
    return listed(
        spark, rows,
        "ordinal int, code string, message string, severity int, category string,"
        " category_label string, rule_type string, suggestion string, context_aware boolean, patterns int",
    )


def split_lines(content: Column) -> Column:
    return F.split(content, "\n")


def _matches(text: Column, pattern: Column) -> Column:
    """Whether a pattern of the table matches. Unlike `rlike`, which compiles a pattern that is no literal for each row, this keeps the last one."""
    return F.regexp_instr(text, pattern) > 0


def _present(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


_NEEDS_NEAR, _NEEDS_STATE = 1, 2
#: Whose lines around a hit are kept: those of every rule, of none but the rules that ask for them, or also of the rules whose code starts so.
Near = bool | tuple[str, ...]
#: The number of the pair that stands for a file itself.
_MARKER = -1


def possible_pairs(
    files: DataFrame, rules: Sequence[Rule], keep_near: Near = False, line_limit: int | None = None, companion: Companion | None = None,
    markers: bool = False,
) -> DataFrame:
    """(file, line, pattern number) pairs worth a look, with the line and what its rule needs around it.

    The lines around are copied into each pair and sorted with it, so `keep_near` is best given as the beginnings of the codes that need them.

    A companion's hits come as pairs, too, with the numbers after the rules' patterns. With `markers` each file has a pair
    without a line, whether anything is found in it or not; its other pairs are ordered by pattern, as those of a stream cannot be sorted later.
    """
    owner = [r for r in rules for _ in r.match]
    wanted = lambda r: r.code.startswith(keep_near) if isinstance(keep_near, tuple) else keep_near
    flags = [(_NEEDS_NEAR if wanted(r) or r.unless_near else 0) + (_NEEDS_STATE if r.code_only else 0) for r in owner]
    patterns = [p for r in rules for p in r.match]
    count = len(patterns)
    keys = [c for c in files.columns if c != "content"]
    if companion:
        flow = FlowPatterns(count, companion.most_lines)
        found = files.withColumn("found", candidates_and_functions(F.col("content"), patterns + companion.patterns, flags + companion.flags, flow, markers))
        found = found.where(F.lit(True) if markers else F.size("found.marks") > 0).withColumn("pairs", F.filter("found.marks", lambda m: candidate_number(m) < count))
    else:
        found = files.withColumn("pairs", line_candidates(F.col("content"), patterns, flags, markers)).where(F.lit(True) if markers else F.size("pairs") > 0)
    if any(f & _NEEDS_STATE for f in flags):
        asks = F.exists("pairs", lambda p: candidate_flag(p, _NEEDS_STATE))
        found = found.withColumn("states", line_states(F.when(asks, F.col("content"))))
    else:
        found = found.withColumn("states", F.lit(None).cast("array<int>"))
    found = found.withColumn("lines", split_lines(F.col("content")))
    told = "struct<name:string,source_line:int,label:string>"

    def expand(p: Column) -> Column:
        line = candidate_line(p)
        around = F.slice(
            F.col("lines"), F.greatest(line - REACH + 1, F.lit(1)), F.least(line, F.lit(REACH)) + REACH + 1
        )
        return F.struct(
            line.alias("line"), candidate_number(p).alias("number"), F.get("lines", line).alias("text"),
            F.when(candidate_flag(p, _NEEDS_NEAR), around).alias("near"), F.get("states", line).alias("state"),
            *[F.lit(None).cast(told).alias("told")] * bool(companion),
        )

    def met(h: Column) -> Column:
        return F.struct(
            h["line"].alias("line"), (h["which"] + count).alias("number"), F.get("lines", h["line"]).alias("text"),
            F.lit(None).cast("array<string>").alias("near"), F.lit(None).cast("int").alias("state"), h["told"].cast(told).alias("told"),
        )

    pairs = F.transform("pairs", expand)
    if companion:
        own = F.filter("found.marks", lambda m: candidate_number(m) >= count)
        hits = F.when(F.size("found.functions") > 0, F.transform(companion.hits(F.col("lines"), own, F.col("found.functions")), met))
        found = found.withColumn("hits", hits)
        pairs = F.when(F.size("hits") > 0, F.concat(pairs, F.col("hits"))).otherwise(pairs)
    if markers:
        kinds = {"line": "int", "number": "int", "text": "string", "near": "array<string>", "state": "int"} | ({"told": told} if companion else {})
        pairs = F.concat(F.array(F.struct(*[F.lit(_MARKER if k == "number" else None).cast(t).alias(k) for k, t in kinds.items()])), pairs)
    pairs = found.select(*keys, F.explode(pairs).alias("pair")).select(*keys, "pair.*")
    if not line_limit:
        return pairs
    return pairs.where((F.length("text") <= line_limit) | (F.col("number") >= count) | (F.col("number") == _MARKER))


def by_pattern(pairs: DataFrame) -> DataFrame:
    """Order the pairs of each partition by pattern, so that a pattern is compiled once per task.

    The optimizer drops a local sort below an aggregate and moves filters under it. The (always true)
    row-number test is a fence: neither happens across a non-deterministic filter. Streams cannot be sorted.
    """
    if pairs.isStreaming:
        return pairs
    return pairs.sortWithinPartitions("number").where(F.monotonically_increasing_id() >= 0)


def raw_hits(
    files: DataFrame, rules: Sequence[Rule], keep_near: Near = False, line_limit: int | None = None, companion: Companion | None = None,
    markers: bool = False,
) -> DataFrame:
    """Every (line, pattern) that matches and passes the conditions of its rule, whatever stands around the match.

    With `markers` the rows of a file stay together, its marker first.
    """
    rules = [r for r in rules if r.kind != ADVISORY]
    table = pattern_table(files.sparkSession, rules, companion, markers)
    named = possible_pairs(files, rules, keep_near, line_limit, companion, markers)
    pairs = (named if markers else by_pattern(named)).join(F.broadcast(table), "number")
    pairs = pairs.where(
        (F.col("only_paths").isNull() | _present(_matches(F.col("path"), F.col("only_paths"))))
        & ~_present(_matches(F.col("path"), F.col("skip_paths")))
    )

    text, met = F.col("text"), F.col("regex").isNull()
    possible = F.coalesce(_matches(text, F.col("guard")), F.lit(True))
    hit = pairs.where((met | (possible & _matches(text, F.col("regex")))) & ~_present(_matches(text, F.col("unless"))))
    safe_near = F.exists("near", lambda l: _matches(l, F.col("unless_near")))
    hit = hit.where(F.col("unless_near").isNull() | ~_present(safe_near))
    if companion:
        hit = hit.withColumn("message", F.when(met, companion.message(F.col("message"), F.col("told"))).otherwise(F.col("message")))
    return hit.withColumn("col", F.when(met, 0).otherwise(F.regexp_instr(text, F.col("regex")) - 1)).withColumn(
        "pattern", F.coalesce("literal", F.regexp_substr(text, F.col("regex")))
    )


def pattern_hits(
    files: DataFrame, rules: Sequence[Rule], keep_near: Near = False, markup: bool = False, line_limit: int | None = None,
    companion: Companion | None = None, markers: bool = False,
) -> DataFrame:
    """The hits that count: not those of code-only rules inside comments, strings or (if asked for) the text of markup."""
    hit = raw_hits(files, rules, keep_near, line_limit, companion, markers)
    if any(r.code_only for r in rules):
        place = F.col("text"), F.col("col")
        masked = inside_comment(*place, F.col("state")) | inside_string(*place, F.col("state"))
        if markup:
            masked = masked | inside_markup_text(*place)
        hit = hit.where(~F.when(F.col("code_only"), masked).otherwise(F.lit(False)))
    lowered = _present(_matches(F.col("path"), F.col("info_paths")))
    return hit.withColumn("severity", F.when(lowered, F.lit(0)).otherwise(F.col("severity")))


def line_findings(
    files: DataFrame, rules: Sequence[Rule], keep_near: Near = False, markup: bool = False, line_limit: int | None = None,
    companion: Companion | None = None, judge: Callable[[DataFrame], DataFrame] | None = None, texts: bool = True,
) -> DataFrame:
    """One row per (rule, line): the first surviving pattern. Each hit of a companion is a row.

    `judge` adds columns to the hits where their text and the lines around them are. What it adds moves in place of these lines and
    of the texts, of which only those of reminders are kept; so it is without `texts`, too. What a pattern's number tells is not moved but looked up
    again.
    """
    rules = [r for r in rules if r.kind != ADVISORY]
    hits = pattern_hits(files, rules, keep_near, markup, line_limit, companion)
    payload = ["number", "col", "severity", "pattern", "text"]
    if judge:
        judged = judge(hits)
        payload += [c for c in judged.columns if c not in hits.columns]
        hits = judged
    elif keep_near:
        payload.append("near")
    if judge or not texts:
        hits = hits.withColumn("text", F.when(F.col("kind") == REMINDER, F.col("text")))
    # One exchange serves this grouping and the choice of reminders after it.
    apart = ["told"] if companion else []
    first = hits.repartition("repo", "path", "code").groupBy(*FILE, "line", "code", *apart).agg(F.min(F.struct(*payload)).alias("h"))
    told = pattern_table(files.sparkSession, rules, companion).select("number", "category", "message", "suggestion", "kind", "rule", F.col("regex").isNull().alias("met"))
    found = first.select(*FILE, "line", "code", *apart, "h.*").join(F.broadcast(told), "number")
    if companion:
        found = found.withColumn("message", F.when(F.col("met"), companion.message(F.col("message"), F.col("told"))).otherwise(F.col("message")))
    return found.drop("number", "met", *apart)


def reminder_score(text: Column) -> Column:
    """How telling a line is for a reminder: bodies and calls before declarations."""
    declares = text.rlike(_DECLARES)
    return (
        F.when(declares, 0).otherwise(1)
        + F.when(text.rlike(_BODY), 2).otherwise(0)
        + F.when(text.rlike(_CALL) & ~declares, 1).otherwise(0)
    )


def pick_reminders(found: DataFrame, within: int | None = None) -> DataFrame:
    """Reminders fire once per file: at the most telling of the lines they match (of the first `within`, if given)."""
    group = Window.partitionBy(*FILE, "code")
    score = reminder_score(F.col("text"))
    if within is not None:
        found = found.withColumn("place", F.row_number().over(group.orderBy("line")))
        score = F.when(F.col("place") <= within, score).otherwise(-1)
    ranked = found.withColumn("score", score).withColumn("rank", F.row_number().over(group.orderBy(F.col("score").desc(), "line")))
    return ranked.where((F.col("kind") != REMINDER) | (F.col("rank") == 1)).drop("place", "score", "rank")


def scan_rules(files: DataFrame, rules: Sequence[Rule], reminder_lines: int | None = None, **options) -> DataFrame:
    """Findings of the rules on the files."""
    return pick_reminders(line_findings(files, rules, texts=False, **options), reminder_lines).select(*FINDING)


def project_advisories(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Advisory rules: any match of any pattern, no line limit, first file per repository and code."""
    advice = [r for r in rules if r.kind == ADVISORY]
    table = pattern_table(files.sparkSession, advice).select(
        "number", "code", "category", "message", "suggestion", "regex"
    )
    hits = (
        by_pattern(possible_pairs(files.select(*FILE, "content"), advice))
        .join(F.broadcast(table), "number")
        .where(_matches(F.col("text"), F.col("regex")))
    )
    return hits.groupBy("repo", "code", "category", "message", "suggestion").agg(
        F.min("path").alias("triggered_by")
    )
