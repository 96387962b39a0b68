"""DuckDB SQL for rule matching, written apart from the Spark plans.

It tests every pattern on every line. Two things need more than a regular expression of RE2: a pattern with look-ahead is
tried at every place and for every length of the part before the look-ahead, and the comment or string around a
match comes from a recursive walk over the marks of a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..rules import Rule
from ..rules.model import ADVISORY, REMINDER, Rx
from .corpus import lines_sql, lit

_LOOK = "(?!"


def re2(p: Rx | str) -> str:
    if isinstance(p, str):
        import re

        return "(?i:" + re.escape(p) + ")"
    return f"(?{p.flags}:{p.text})" if p.flags else f"(?:{p.text})"


def looks_ahead(p: Rx | str) -> bool:
    return isinstance(p, Rx) and _LOOK in p.text


def needs_context(r: Rule) -> bool:
    """Does the rule look ahead, or at the comment or string around a match?"""
    return r.code_only or any(looks_ahead(p) for p in [*r.match, *r.unless, *r.unless_near])


def parts(text: str) -> list[tuple[str, str | None]]:
    """A pattern cut at its look-aheads: (before, refused) pairs, then (rest, None)."""
    out: list[tuple[str, str | None]] = []
    at = 0
    while (start := text.find(_LOOK, at)) >= 0:
        depth, end, in_class = 1, start + len(_LOOK), False
        while depth:
            c = text[end]
            if c == "\\":
                end += 1
            elif in_class:
                in_class = c != "]"
            elif c == "[":
                in_class = True
            else:
                depth += {"(": 1, ")": -1}.get(c, 0)
            end += 1
        out.append((text[at:start], text[start + len(_LOOK) : end - 1]))
        at = end
    return [*out, (text[at:], None)]


def _anchored(p: Rx, text: str, end: str = "") -> str:
    flags = p.flags.replace("m", "")
    return lit(f"^(?{flags}:{text}){end}")


def _ends(p: Rx, cut: list[tuple[str, str | None]], column: str, start: str, depth: int = 0) -> str:
    """A list of the places where the part of a pattern that goes on at `start` can end, in the order in which they are tried."""
    before, refused = cut[0]
    if refused is None:
        return f"[{start} + length(regexp_extract({column}[{start}:], {_anchored(p, before)})) - 1]" if before else f"[{start} - 1]"
    j = f"j{depth}"
    tests = [f"regexp_matches({column}[{start}:{j}], {_anchored(p, before, '$')})", f"NOT regexp_matches({column}[{j} + 1:], {_anchored(p, refused)})"]
    if before.endswith("\\b"):
        tests.append(f"NOT regexp_matches({column}[{j} + 1:{j} + 1], '\\w')")
    rest = cut[1:]
    if rest[0][1] is None and rest[0][0]:
        tests.append(f"regexp_matches({column}[{j} + 1:], {_anchored(p, rest[0][0])})")
    places = f"list_filter(list_reverse(range({start} - 1, length({column}) + 1)), lambda {j}: {' AND '.join(tests)})"
    return f"flatten(list_transform({places}, lambda {j}: {_ends(p, rest, column, f'({j} + 1)', depth + 1)}))"


def _places(p: Rx, column: str) -> str:
    """A list of structs (p, j): where a pattern with look-ahead matches and where it ends, the first place first."""
    cut = parts(p.text)
    first = cut[0][0]
    tests = [f"regexp_matches({column}[p:], {_anchored(p, first)})"]
    if first.startswith("^"):
        tests.append("p = 1")
    if first.startswith("\\b"):
        tests.append(f"(p = 1 OR NOT regexp_matches({column}[p - 1:p - 1], '\\w'))")
    starts = f"list_filter(range(1, length({column}) + 1), lambda p: {' AND '.join(tests)})"
    found = f"list_filter(list_transform({starts}, lambda p: {{'p': p, 'j': ({_ends(p, cut, column, 'p')})[1]}}), lambda x: x.j IS NOT NULL)"
    return f"CASE WHEN regexp_matches({column}, {_anchored(p, first).replace('^', '', 1)}) THEN {found} ELSE [] END"


def matches(column: str, patterns: Sequence[Rx | str]) -> str:
    plain = [p for p in patterns if not looks_ahead(p)]
    tests = [f"regexp_matches({column}, {lit('|'.join(re2(p) for p in plain))})"] if plain else []
    return " OR ".join([*tests, *(f"len({_places(p, column)}) > 0" for p in patterns if looks_ahead(p))])


def hits(rules: Sequence[Rule], prefix: str = "") -> str:
    """SELECT of (repo, path, language, line, text, number, rule, code, severity, category, kind, col, pattern, code_only)."""
    selects, number = [], 0
    for place, r in enumerate(rules):
        for p in r.match:
            tests = [matches("text", [p])]
            if r.unless:
                tests.append(f"NOT ({matches('text', r.unless)})")
            if r.only_paths:
                tests.append(matches("path", r.only_paths))
            if r.skip_paths:
                tests.append(f"NOT ({matches('path', r.skip_paths)})")
            if r.unless_near:
                tests.append(
                    f"NOT EXISTS (SELECT 1 FROM {prefix}lines n WHERE n.repo = l.repo AND n.path = l.path"
                    f" AND n.line BETWEEN l.line - 3 AND l.line + 3 AND ({matches('n.text', r.unless_near)}))"
                )
            severity = str(r.severity)
            if r.info_paths:
                severity = f"CASE WHEN {matches('path', r.info_paths)} THEN 0 ELSE {r.severity} END"
            col = f"length(regexp_extract(text, {lit('^((?s:.*?))' + re2(p))}, 1))::INT"
            pattern = f"regexp_extract(text, {lit(re2(p))})"
            if looks_ahead(p):
                first = f"({_places(p, 'text')})[1]"
                col, pattern = f"({first}.p - 1)::INT", f"text[{first}.p:{first}.j]"
            selects.append(
                f"SELECT repo, path, language, line, text, {number} AS number, {place} AS rule, {lit(r.code)} AS code,"
                f" {severity} AS severity, {lit(r.category)} AS category, {lit(r.kind)} AS kind,"
                f" {col} AS col, {pattern} AS pattern, {r.code_only} AS code_only"
                f" FROM {prefix}lines l WHERE {' AND '.join(f'({t})' for t in tests)}"
            )
            number += 1
    return "\n UNION ALL ".join(selects)


_MARKS = r"""\\/*'"`{}$"""
_PIECES = f"regexp_extract_all(text, {lit(f'[^{_MARKS}]*[{_MARKS}]')})"
_OPENS = r"(?:^|[(,=:\[{;&|!?+\-*<>~^%]|(?:^|[^a-zA-Z0-9_])(?:return|typeof|instanceof|in|of|new|delete|void|yield|await|throw))[ \t]*$"
_LITERAL = r"^/(?:\\(?s:.)|\[(?:\\(?s:.)|[^\]\\])*\]|[^/\[\\])*/"


def states(prefix: str = "") -> str:
    """CTE from `lines` to `states` (repo, path, line, state): a walk of one step a mark over every file at once.

    mode is 0 in code, 1 and 2 in quotes, 3 in a template, 4 in a block comment; n counts open template expressions, b the
    braces inside the innermost one, and marks before `skip` are spent.
    """
    enters, leaves = "(mode = 3 AND mark = '$' AND follows = '{')", "(mode = 0 AND mark = '}' AND n > 0 AND b = 0)"
    return f"""{prefix}states AS MATERIALIZED (
  WITH RECURSIVE pieces AS (SELECT repo, path, line, text, unnest({_PIECES}) AS piece, generate_subscripts({_PIECES}, 1) AS k FROM {prefix}lines),
  placed AS (SELECT repo, path, line, text, k, right(piece, 1) AS mark, sum(length(piece)) OVER (PARTITION BY repo, path, line ORDER BY k)::BIGINT AS pos FROM pieces),
  marked AS (SELECT repo, path, line, k, pos, mark, text[pos + 1:pos + 1] AS follows, FALSE AS tail,
      CASE WHEN mark = '/' AND regexp_matches(text[1:pos - 1], {lit(_OPENS)}) THEN length(regexp_extract(text[pos:], {lit(_LITERAL)})) ELSE 0 END AS literal FROM placed
    UNION ALL SELECT repo, path, line, 2147483647, 0, 'end', '', ends_with(text, chr(92)), 0 FROM {prefix}lines),
  marks AS MATERIALIZED (SELECT (repo, path) AS file, * EXCLUDE (k), row_number() OVER (PARTITION BY repo, path ORDER BY line, k) AS i FROM marked),
  run AS (SELECT DISTINCT file, 0::BIGINT AS i, 0 AS mode, 0 AS n, 0 AS b, 0::BIGINT AS skip FROM marks
    UNION ALL SELECT file, i,
      CASE WHEN mark = 'end' THEN CASE WHEN mode IN (1, 2) AND NOT tail THEN 0 ELSE mode END WHEN pos < skip THEN mode
        WHEN mode = 0 THEN CASE WHEN mark = '/' AND follows = '*' THEN 4 WHEN mark = '''' THEN 1 WHEN mark = '"' THEN 2 WHEN mark = '`' OR {leaves} THEN 3 ELSE 0 END
        WHEN mode = 1 AND mark = '''' OR mode = 2 AND mark = '"' OR mode = 3 AND mark = '`' OR {enters} OR mode = 4 AND mark = '*' AND follows = '/' THEN 0 ELSE mode END,
      CASE WHEN pos < skip THEN n WHEN {enters} THEN n + 1 WHEN {leaves} THEN n - 1 ELSE n END,
      CASE WHEN pos < skip THEN b WHEN {enters} THEN 0 WHEN mode = 0 AND n > 0 AND mark = '{{' THEN b + 1 WHEN mode = 0 AND n > 0 AND mark = '}}' AND b > 0 THEN b - 1 ELSE b END,
      CASE WHEN mark = 'end' THEN 0 WHEN pos < skip THEN skip WHEN mode = 0 AND mark = '/' AND follows = '/' THEN 2147483647 WHEN mode = 0 AND mark = '/' AND follows = '*' THEN pos + 2
        WHEN mode = 0 AND mark = '/' AND literal > 0 THEN pos + literal WHEN mode IN (1, 2, 3) AND mark = chr(92) OR {enters} OR mode = 4 AND mark = '*' AND follows = '/' THEN pos + 2 ELSE skip END
    FROM (SELECT r.* EXCLUDE (i), m.* EXCLUDE (file) FROM run r JOIN marks m ON m.file = r.file AND m.i = r.i + 1))
  SELECT l.repo, l.path, l.line, coalesce(s.state, 0)::INT AS state FROM {prefix}lines l LEFT JOIN (
    SELECT m.repo, m.path, m.line + 1 AS line, CASE r.mode WHEN 0 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 4 ELSE 1 END + 8 * r.n AS state
    FROM run r JOIN marks m ON m.file = r.file AND m.i = r.i WHERE m.mark = 'end') s ON s.repo = l.repo AND s.path = l.path AND s.line = l.line)"""


# Is the match at `col` of a line `text` that begins in `state` inside a comment, a string, the text of markup?
_BEFORE = "text[1:strpos(text, '//') - 1]"
_EVEN = " AND ".join(f"(length({_BEFORE}) - length(replace({_BEFORE}, {q}, ''))) % 2 = 0" for q in ("''''", "'\"'", "'`'"))
INSIDE_COMMENT = f"""((state & 4) <> 0 AND (strpos(text, '*/') = 0 OR col < strpos(text, '*/') + 1) OR strpos(text, '//') > 0 AND col >= strpos(text, '//') AND {_EVEN}
  OR len(list_filter(range(1, col + 2), lambda p: text[p:p + 1] = '/*' AND (strpos(text[p + 2:], '*/') = 0 OR col < p + strpos(text[p + 2:], '*/') + 2))) > 0)"""
_QUOTES = """list_filter(range(1, col + 1), lambda p: (text[p:p] IN ('''', '"', '`', '}') OR text[p:p + 1] = '${') AND (p = 1 OR text[p - 1:p - 1] <> chr(92)))"""
INSIDE_STRING = f"""(list_transform([list_reduce(list_prepend({{'m': '', 's': (state & 1) <> 0, 'd': FALSE, 't': (state & 2) <> 0, 'n': (state // 8)::INT}},
    list_transform({_QUOTES}, lambda p: {{'m': text[p:p], 's': FALSE, 'd': FALSE, 't': FALSE, 'n': 0::INT}})), lambda a, x: {{'m': '',
      's': CASE WHEN x.m = '''' AND NOT a.d AND NOT a.t THEN NOT a.s ELSE a.s END, 'd': CASE WHEN x.m = '"' AND NOT a.s AND NOT a.t THEN NOT a.d ELSE a.d END,
      't': CASE WHEN x.m = '`' AND NOT a.s AND NOT a.d THEN NOT a.t ELSE a.t END, 'n': (a.n + CASE WHEN a.t AND x.m = '$' THEN 1 WHEN a.t AND a.n > 0 AND x.m = '}}' THEN -1 ELSE 0 END)::INT}})],
  lambda r: r.s OR r.d OR r.t AND r.n = 0)[1])"""
INSIDE_MARKUP = "(contains(text[1:col], '>') AND NOT contains(regexp_extract(text[1:col], '>([^>]*)$', 1), '<') AND contains(text[col + 1:], '<'))"


_SCORE = """(CASE WHEN regexp_matches(text, '^\\s*(?:import\\s|export\\s(?:type|interface|default)|const\\s|let\\s|var\\s|type\\s|interface\\s|class\\s)') THEN 0 ELSE 1 END
   + CASE WHEN regexp_matches(text, '(?:function\\s|=>\\s*\\{|\\.(?:then|catch|map|forEach|filter|reduce)\\s*\\()') THEN 2 ELSE 0 END
   + CASE WHEN regexp_matches(text, '\\w+\\s*\\(') AND NOT regexp_matches(text, '^\\s*(?:import\\s|export\\s(?:type|interface|default)|const\\s|let\\s|var\\s|type\\s|interface\\s|class\\s)') THEN 1 ELSE 0 END)"""


def findings(rules: Sequence[Rule], files: str, prefix: str = "", markup: bool = False) -> str:
    """CTEs (after WITH) from a `files` CTE to a `findings` CTE; all names start with the prefix."""
    chosen = [r for r in rules if r.kind != ADVISORY]
    words = ",\n".join(f"({lit(r.code)}, {lit(r.message)}, {lit(r.suggestion)})" for r in chosen)
    p = prefix
    walked, kept = "", f"SELECT * EXCLUDE (code_only) FROM {p}raw"
    if any(r.code_only for r in chosen):
        masked = f"{INSIDE_COMMENT} OR {INSIDE_STRING}" + f" OR {INSIDE_MARKUP}" * markup
        walked = f"{states(p)},\n  "
        kept += (f" WHERE NOT code_only UNION ALL SELECT * EXCLUDE (code_only, state) FROM (SELECT r.*, s.state FROM {p}raw r"
                 f" JOIN {p}states s ON s.repo = r.repo AND s.path = r.path AND s.line = r.line WHERE code_only) WHERE NOT ({masked})")
    return f"""{files},{lines_sql(p)},
  {p}raw AS MATERIALIZED ({hits(chosen, p)}),
  {walked}{p}hits AS ({kept}),
  {p}firsts AS (SELECT * FROM {p}hits QUALIFY row_number() OVER (PARTITION BY repo, path, line, rule ORDER BY number) = 1),
  {p}placed AS (SELECT *, {_SCORE} AS score FROM {p}firsts),
  {p}ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, path, code ORDER BY score DESC, line) AS best FROM {p}placed),
  {p}words(code, message, suggestion) AS (VALUES {words}),
  {p}findings AS MATERIALIZED (SELECT repo, path, language, line, col, r.code, severity, category, message, suggestion, pattern, text
             FROM {p}ranked r JOIN {p}words w ON w.code = r.code WHERE kind <> '{REMINDER}' OR best = 1)"""
