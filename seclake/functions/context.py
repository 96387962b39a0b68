"""Is a position inside a comment or inside a string?

`line_states` notes how each line of a text begins. Only marks (quotes, slashes, stars, braces, dollar signs and backslashes)
can change that, so a text is cut at its marks and the automaton takes one step a mark; lines that cannot change the
state they begin in are passed over whole. The counters of open template expressions and their braces have no bound, so
the steps of one file run in order, inside its row; files are independent of each other. Everything is a
built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

QUOTED, TEMPLATE, BLOCK, DEPTH = 1, 2, 4, 8

# What may stand before a slash that opens a regular expression.
_OPENERS = "(,=:[{;&|!?+-*<>~^%"
_WORDS = ("return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "yield", "await", "throw")

_MARKS = r"""\\/*'"`{}$"""
#: Text up to and with the next mark.
_PIECE = f"[^{_MARKS}]*+[{_MARKS}]"
_AFTER_OPENER = r"(?:[(,=:\[;&|!?+\-<>~^%]|(?<![a-zA-Z0-9_])(?:" + "|".join(_WORDS) + r"))[ \t]*+/\z"
#: A regular expression and its closing slash; no part of it recurses with its length.
_REGEX_LITERAL = r"(?s)\A/(?:[^/\[\\]++|\\.|\[(?:[^\]\\]++|\\.)*+\])*+/"

_CODE, _SINGLE, _DOUBLE, _TICK, _STAR = range(5)
#: Lines are folded so many at a time, so that the list of their states is short while it grows.
_TOGETHER = 256
_END = (1 << 31) - 1


def _tokens(line: Column) -> Column:
    """array<struct(size, mark, next, opens)>: the pieces of a line, the mark that follows directly, and whether a slash may open a regular expression."""

    def token(pieces: Column, piece: Column, i: Column) -> Column:
        follows = F.get(pieces, i + 1)
        before = F.when(i > 0, F.right(F.get(pieces, i - 1), F.lit(1)))
        opens = F.when(F.length(F.btrim(piece, F.lit(" \t"))) == 1, before.isNull() | before.isin("{", "*")).otherwise(F.rlike(piece, F.lit(_AFTER_OPENER)))
        mark = F.right(piece, F.lit(1))
        return F.struct(
            F.length(piece).alias("size"), mark.alias("mark"), F.when(F.length(follows) == 1, follows).otherwise("").alias("next"),
            F.when(mark == "/", opens).otherwise(False).alias("opens"),
        )

    return let(F.regexp_extract_all(line, F.lit(_PIECE), F.lit(0)), lambda pieces: F.transform(pieces, lambda x, i: token(pieces, x, i)))


def _walked(line: Column, start: Column) -> Column:
    """struct(mode, open, braces): the state after a line that begins in the state `start`."""

    def step(a: Column, t: Column) -> Column:
        mode, opened, braces, mark = a["mode"], a["open"], a["braces"], t["mark"]
        at = a["at"] + t["size"] - 1
        code, tick, quoted = mode == _CODE, mode == _TICK, mode.isin(_SINGLE, _DOUBLE)
        slash = code & (mark == "/")
        comment, block = slash & (t["next"] == "/"), slash & (t["next"] == "*")
        literal = F.when(slash & ~comment & ~block & t["opens"], F.length(F.regexp_extract(F.substring(line, at + 1, F.length(line)), _REGEX_LITERAL, 0))).otherwise(0)
        enters = tick & (mark == "$") & (t["next"] == "{")
        leaves = code & (opened > 0) & (braces == 0) & (mark == "}")
        closes = (mode == _STAR) & (mark == "*") & (t["next"] == "/")
        escapes = (quoted | tick) & (mark == "\\")
        new_mode = (
            F.when(code, F.when(block, _STAR).when(mark == "'", _SINGLE).when(mark == '"', _DOUBLE).when((mark == "`") | leaves, _TICK).otherwise(_CODE))
            .when((mode == _SINGLE) & (mark == "'") | (mode == _DOUBLE) & (mark == '"') | tick & (mark == "`") | enters | closes, _CODE)
            .otherwise(mode)
        )
        counted = F.when(code & (opened > 0), F.when(mark == "{", 1).when((mark == "}") & ~leaves, -1).otherwise(0)).otherwise(0)
        skip = F.when(comment, _END).when(block | enters | closes | escapes, at + 2).when(literal > 0, at + literal).otherwise(a["skip"])
        moved = F.struct(
            new_mode.alias("mode"), (opened + F.when(enters, 1).when(leaves, -1).otherwise(0)).alias("open"),
            F.when(enters, 0).otherwise(braces + counted).alias("braces"), (at + 1).alias("at"), skip.alias("skip"),
        )
        passed = F.struct(mode.alias("mode"), opened.alias("open"), braces.alias("braces"), (at + 1).alias("at"), a["skip"].alias("skip"))
        return F.when(at < a["skip"], passed).otherwise(moved)

    first = F.struct(start["mode"].alias("mode"), start["open"].alias("open"), start["braces"].alias("braces"), F.lit(0).alias("at"), F.lit(0).alias("skip"))
    # A quoted string ends with its line, unless a backslash stands there.
    mode = lambda a: F.when(a["mode"].isin(_SINGLE, _DOUBLE) & ~F.endswith(line, F.lit("\\")), _CODE).otherwise(a["mode"])
    return F.aggregate(_tokens(line), first, step, lambda a: F.struct(mode(a).alias("mode"), a["open"].alias("open"), a["braces"].alias("braces")))


def _may_change(line: Column, state: Column) -> Column:
    """Can the line end in another state than it begins in?"""
    in_code = F.rlike(line, F.lit("['\"`]|/\\*")) | ((state["open"] > 0) & F.rlike(line, F.lit("[{}]")))
    return (
        F.when(state["mode"] == _CODE, in_code).when(state["mode"] == _TICK, F.contains(line, F.lit("`")) | F.contains(line, F.lit("${")))
        .when(state["mode"] == _STAR, F.contains(line, F.lit("*/"))).otherwise(True)
    )


def line_states(content: Column) -> Column:
    """array<int>, one number per line: QUOTED, TEMPLATE or BLOCK, plus DEPTH per open template expression."""
    names = ("mode", "open", "braces")
    kept = lambda a: [a[n].alias(n) for n in names]
    clean = F.struct(*[F.lit(0).alias(n) for n in names])
    number = lambda a: F.when(a["mode"] == _CODE, 0).when(a["mode"] == _TICK, TEMPLATE).when(a["mode"] == _STAR, BLOCK).otherwise(QUOTED) + a["open"] * DEPTH

    def line_step(a: Column, line: Column) -> Column:
        after = F.when(_may_change(line, a["state"]), _walked(line, a["state"])).otherwise(a["state"])
        return F.struct(after.alias("state"), F.concat(a["out"], F.array(number(a["state"]))).alias("out"))

    def part_step(a: Column, part: Column) -> Column:
        begin = F.struct(F.struct(*kept(a["state"])).alias("state"), F.array().cast("array<int>").alias("out"))
        return let(F.aggregate(part, begin, line_step), lambda r: F.struct(F.struct(*kept(r["state"])).alias("state"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    def walked(lines: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / _TOGETHER)), lambda i: F.slice(lines, (i * _TOGETHER + 1).cast("int"), F.lit(_TOGETHER)))
        begin = F.struct(clean.alias("state"), F.array().cast("array<array<int>>").alias("out"))
        return F.flatten(F.aggregate(parts, begin, part_step, lambda a: a["out"]))

    return F.when(content.isNotNull(), let(F.split(content, "\n"), walked))


def _quotes(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) % 2


def inside_comment(text: Column, col: Column, state: Column) -> Column:
    close = F.instr(text, "*/")
    in_block = state.bitwiseAND(BLOCK) != 0
    carried = in_block & ((close == 0) | (col < close + 1))
    slashes = F.instr(text, "//")
    before = F.substring(text, F.lit(1), slashes - 1)
    even = (_quotes(before, "'") == 0) & (_quotes(before, '"') == 0) & (_quotes(before, "`") == 0)
    after_slashes = (slashes > 0) & (col > slashes - 1) & even
    # Opened on this line, with no close between the opener and the match.
    left_open = F.substring(text, F.lit(1), col).rlike(r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+\z")
    at_opener = (F.substring(text, col + 1, F.lit(2)) == "/*") | (
        (col > 0) & (F.substring(text, col, F.lit(2)) == "/*")
    )
    return carried | after_slashes | left_open | at_opener


def inside_string(text: Column, col: Column, state: Column) -> Column:
    """Fold over the marks before the match that no backslash precedes, starting from the state of the line."""
    # One mark stands for a dollar sign that opens a template expression.
    head = F.replace(F.substring(text, F.lit(1), col + 1), F.lit("${"), F.lit("\u0001{"))
    marks = F.regexp_extract_all(F.substring(head, F.lit(1), col), F.lit("(?<!\\\\)['\"`}\u0001]"), F.lit(0))

    def step(a: Column, mark: Column) -> Column:
        s, d, t, n = a["s"], a["d"], a["t"], a["n"]
        single, double, tick = ~d & ~t & (mark == "'"), ~s & ~t & (mark == '"'), ~s & ~d & (mark == "`")
        opens, closes = t & (mark == "\u0001"), t & (n > 0) & (mark == "}")
        return F.struct(F.when(single, ~s).otherwise(s).alias("s"), F.when(double, ~d).otherwise(d).alias("d"), F.when(tick, ~t).otherwise(t).alias("t"),
                        F.when(opens, n + 1).when(closes, n - 1).otherwise(n).alias("n"))

    start = F.struct(
        (state.bitwiseAND(QUOTED) != 0).alias("s"),
        F.lit(False).alias("d"),
        (state.bitwiseAND(TEMPLATE) != 0).alias("t"),
        F.floor(state / DEPTH).cast("int").alias("n"),
    )
    return F.aggregate(marks, start, step, lambda a: a["s"] | a["d"] | (a["t"] & (a["n"] == 0)))


def inside_markup_text(text: Column, col: Column) -> Column:
    """Between a closing and an opening angle bracket."""
    before, after = F.substring(text, F.lit(1), col), F.substring(text, col + 1, F.length(text))
    tail = F.substring_index(before, ">", -1)
    return before.contains(">") & ~tail.contains("<") & after.contains("<")
