"""Queries over matching: patterns, conditions, context, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.context import inside_comment, inside_markup_text, inside_string, line_states
from ..operators import history, matching, statistics, suppression
from ..plans.scan import enabled_rules
from ..rules import CATEGORY_LABELS, Rule, all_rules, family, history_rules, rx
from ..rules.model import ADVISORY, CODE
from ..sources.files import lines
from . import corpus, inputs, oracle
from .corpus import lit, lines_sql, duck, sql_table
from .registry import query
from .sources import ADDED

PLACE = ["repo", "path", "line", "col", "code", "severity", "pattern"]


def custom(code: str, *match, severity: int = 1, **conditions) -> Rule:
    return Rule(code, "secrets-credentials", severity, CODE, match=list(match), message=code, suggestion="", **conditions)


def _matching(key: str, rules: list[Rule], read=corpus.code, files_sql: str = corpus.CODE):
    cols = ", ".join(PLACE)

    @query(key, f"WITH {oracle.findings(rules, files_sql)}\nSELECT {cols} FROM findings")
    def run(spark, sf):
        return matching.scan_rules(read(spark, sf), rules).select(*PLACE)


_LABEL = "CASE category " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in CATEGORY_LABELS.items()) + " ELSE category END"
_SEV = "CASE severity WHEN 2 THEN 'Error' WHEN 1 THEN 'Warning' ELSE 'Info' END"
_RULES = ", ".join(f"({lit(r.code)}, {lit(r.category)}, {r.severity}, {lit(r.kind)}, {lit(r.message)})" for r in all_rules())


_LISTING = f"""WITH {inputs.FINDINGS}, rules(code, category, severity, rule_type, message) AS (VALUES {_RULES}),
  counts AS (SELECT code, count(*) AS n FROM findings GROUP BY code)
SELECT r.code, {_LABEL} AS category_label, severity, rule_type, message, coalesce(n, 0) AS found
FROM rules r LEFT JOIN counts c ON c.code = r.code WHERE contains(lower({_LABEL}), 'auth')"""


@query("flt01_rule_listing", _LISTING)
@query("flt01_rule_listing_all_rules", _LISTING)
def rule_listing(spark, sf):
    """The catalogue filtered by label, with what each rule found."""
    rules = matching.rule_table(spark, all_rules()).where(F.lower("category_label").contains("auth"))
    counts = inputs.findings(spark, sf).groupBy("code").agg(F.count("*").alias("found"))
    return rules.join(counts, "code", "left").select(
        "code", "category_label", "severity", "rule_type", "message", F.coalesce("found", F.lit(0)).alias("found")
    )


_LITERALS = [custom("LIT001", "TOKEN"), custom("LIT002", "license", "Password"), custom("LIT003", "app.use(")]


@query("flt02_literal_patterns", f"""WITH {corpus.CODE},{lines_sql()}, p(code, n, word) AS (VALUES ('LIT001', 0, 'TOKEN'), ('LIT002', 0, 'license'), ('LIT002', 1, 'Password'), ('LIT003', 0, 'app.use('))
SELECT repo, path, line, (position(lower(word) IN lower(text)) - 1)::INT AS col, code, 1 AS severity, word AS pattern
FROM lines, p WHERE contains(lower(text), lower(word)) QUALIFY row_number() OVER (PARTITION BY repo, path, line, code ORDER BY n) = 1""")
def literal_patterns(spark, sf):
    return matching.scan_rules(corpus.code(spark, sf), _LITERALS).select(*PLACE)


_matching("flt03_regex_patterns", [custom("RX001", rx(r"\b[a-f0-9]{40}\b")), custom("RX002", rx(r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b")),
                                   custom("RX003", rx(r"[\w.+-]+@[\w-]+\.[a-z]{2,}", "i"))], corpus.documents, corpus.DOCUMENTS)
_matching("flt04_first_surviving_pattern", [custom("FT001", rx(r"token\s*="), rx(r"const\s+\w+", "i"), rx(r"\w+\(", "")),
                                            custom("FT002", rx(r"password", "i"), rx(r"pass", "i"), unless=[rx(r"localStorage")])])
_matching("flt05_file_gate", [custom("FG001", rx(r"true", "i"), only_paths=[rx(r"\.ya?ml$", "i"), rx(r"^src/")], skip_paths=[rx(r"[13579]\.js$")])])
_matching("flt06_lowered_severity", [custom("LS001", rx(r"app\.\w+\("), severity=2, info_paths=[rx(r"routes?/", "i"), rx(r"internal")])])
_matching("flt07_unless_on_line", [custom("UL001", rx(r"const\s+\w+"), unless=[rx(r"require|token", "i"), "mask"])])
_matching("flt08_unless_nearby", [custom("UN001", rx(r"const\s+\w+"), unless_near=[rx(r"validate|session", "i")]),
                                  custom("UN002", rx(r"let\s+\w+"), unless_near=[rx(r"jwt\.decode")])])

@query("flt09_line_states", f"WITH {corpus.CODE},{lines_sql()}, {oracle.states()} SELECT repo, path, line, state FROM states WHERE state <> 0")
def states(spark, sf):
    """How each line of every file begins, where that is not in plain code."""
    files = corpus.code(spark, sf)
    s = files.select("repo", "path", F.posexplode(line_states(F.col("content"))).alias("line", "state"))
    return s.where(F.col("state") != 0)


# What the context is asked about: every match of every rule that must not fire in comments and strings.
_CODE_ONLY = [r for r in all_rules() if r.code_only]
_ASKED = f"""WITH {corpus.CODE},{lines_sql()}, {oracle.states()}, hits AS ({oracle.hits(_CODE_ONLY)}),
  asked AS (SELECT h.repo, h.path, h.line, h.col, h.code, h.number, h.text, s.state FROM hits h JOIN states s ON s.repo = h.repo AND s.path = h.path AND s.line = h.line)"""


def _asked(spark, sf, inside):
    hits = matching.raw_hits(corpus.code(spark, sf), _CODE_ONLY)
    return hits.select("repo", "path", "line", "col", "code", "number", inside(F.col("text"), F.col("col"), F.col("state")).alias("inside"))


@query("flt10_inside_comment", f"{_ASKED} SELECT repo, path, line, col, code, number, {oracle.INSIDE_COMMENT} AS inside FROM asked")
def in_comment(spark, sf):
    return _asked(spark, sf, inside_comment)


@query("flt11_inside_string", f"{_ASKED} SELECT repo, path, line, col, code, number, {oracle.INSIDE_STRING} AS inside FROM asked")
def in_string(spark, sf):
    return _asked(spark, sf, inside_string)


@query("flt12_inside_markup_text", f"""WITH {corpus.PAGES},{lines_sql()}, m AS (SELECT repo, path, line, length(regexp_extract(text, '^((?s:.*?))(?:class|the)', 1))::INT AS col, text FROM lines WHERE regexp_matches(text, 'class|the')),
  s AS (SELECT *, text[1:col] AS b, text[col + 1:] AS a FROM m)
SELECT repo, path, line, col, contains(b, '>') AND NOT contains(regexp_extract(b, '>([^>]*)$', 1), '<') AND contains(a, '<') AS inside FROM s""")
def in_markup(spark, sf):
    rows = lines(corpus.pages(spark, sf)).where(F.col("text").rlike("class|the"))
    col = F.regexp_instr("text", F.lit("class|the")) - 1
    return rows.select("repo", "path", "line", col.alias("col"), inside_markup_text(F.col("text"), col).alias("inside"))


_COLS = ", ".join(PLACE)


@query("flt13_severity_threshold", f"WITH {inputs.FINDINGS} SELECT {_COLS} FROM findings WHERE severity >= 1")
def threshold(spark, sf):
    return suppression.at_least(inputs.findings(spark, sf), "warning").select(*PLACE)


@query("flt14_without_info", f"WITH {inputs.FINDINGS} SELECT {_COLS} FROM findings WHERE severity <> 0")
def no_info(spark, sf):
    return suppression.without_info(inputs.findings(spark, sf)).select(*PLACE)


_INTERNAL = "regexp_matches(path, '(?i)[/\\\\](?:scripts?|admin|internal|tools?|seed|migrations?|fixtures?)[/\\\\]')"
_XXE = family("xxe") + family("ldap")


@query("flt15_internal_paths", f"""WITH {oracle.findings(_XXE, corpus.CODE)} SELECT repo, path, line, col, code,
  CASE WHEN {_INTERNAL} AND severity = 1 THEN 0 ELSE severity END AS severity, pattern FROM findings WHERE NOT ({_INTERNAL} AND severity = 0)""")
def internal(spark, sf):
    return suppression.internal_paths(matching.scan_rules(corpus.code(spark, sf), _XXE)).select(*PLACE)


_SOME = [r for r in inputs.RULES if r.category in ("cors-configuration", "auth-access-control")]


@query("flt16_enabled", f"WITH {oracle.findings(_SOME, corpus.CODE)} SELECT {_COLS} FROM findings WHERE language IN ('javascript', 'python')")
def enabled(spark, sf):
    """Categories are chosen before the plan is built, languages before any text is matched."""
    rules = enabled_rules(inputs.RULES, ["cors-configuration", "auth-access-control"])
    files = corpus.code(spark, sf).where(F.col("language").isin("javascript", "python"))
    return matching.scan_rules(files, rules).select(*PLACE)


@query("flt17_browse", f"""WITH {inputs.FINDINGS}, {inputs.STATUS_SQL}, shown AS (SELECT f.*, coalesce(s.status, 'pending') AS status, {_SEV} AS severity_label, {_LABEL} AS category_label
    FROM findings f LEFT JOIN statuses s USING (repo, path, code, line, pattern))
SELECT repo, path, line, code, severity_label, category_label, status FROM shown
WHERE severity_label IN ('Error', 'Warning') AND status = 'pending' AND contains(lower(concat_ws(' ', message, code, path, suggestion, category_label)), 'session')""")
def browse(spark, sf):
    from ..operators.lifecycle import with_status

    found = inputs.stored_findings(spark, sf)
    found = with_status(found, inputs.statuses(spark, sf, found))
    shown = statistics.browse(found, ["Error", "Warning"], status="pending", search="Session", sort="path", ascending=False)
    return shown.select("repo", "path", "line", "code", "severity_label", "category_label", "status")


_ADVICE = [r for r in all_rules() if r.kind == ADVISORY]


@query("flt18_project_advisories", f"""WITH {corpus.CODE},{lines_sql()}, hits AS ({oracle.hits(_ADVICE)})
SELECT repo, code, category, min(path) AS triggered_by FROM hits GROUP BY repo, code, category""")
def advisories(spark, sf):
    found = matching.project_advisories(corpus.code(spark, sf), all_rules())
    return found.select("repo", "code", "category", "triggered_by")


_HISTORY_SQL = f"""WITH {oracle.findings(history_rules(), corpus.CODE)}, r(code) AS (VALUES {", ".join(f"({lit(r.code)})" for r in history_rules())})
SELECT r.code, count(f.code) AS found FROM r LEFT JOIN findings f ON f.code = r.code GROUP BY r.code"""


@query("flt19_history_rules", _HISTORY_SQL)
@query("flt19_history_rules_all_rules", _HISTORY_SQL)
def history_rule_set(spark, sf):
    """The rules that run over history, with what they find in current files."""
    rules = matching.rule_table(spark, history_rules()).select("code")
    found = matching.scan_rules(corpus.code(spark, sf), history_rules()).groupBy("code").agg(F.count("*").alias("found"))
    return rules.join(found, "code", "left").select("code", F.coalesce("found", F.lit(0)).alias("found"))


_IGNORE_LISTS = "SELECT source AS repo, lang || '/' AS folder, text || chr(10) || '.env*' || chr(10) || '# credentials.json' || CASE WHEN lang = 'en' THEN chr(10) || '**/credentials.json' ELSE '' END AS content FROM {documents}"


@query("flt20_uncovered_names", f"""WITH lists AS ({duck(_IGNORE_LISTS)}), entries AS (SELECT repo, trim(unnest(string_split(content, chr(10)))) AS l FROM lists),
  r AS (SELECT DISTINCT source AS repo FROM documents UNION SELECT DISTINCT role FROM conversations), names(i, n) AS (VALUES (1, '.env'), (2, 'credentials.json'), (3, 'serviceAccountKey')),
  missing AS (SELECT repo, i, n FROM r, names WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.repo = r.repo AND e.l <> '' AND e.l NOT LIKE '#%' AND contains(e.l, n)))
SELECT repo, string_agg(n, ', ' ORDER BY i) AS pattern, CASE WHEN repo IN (SELECT source FROM documents) THEN '.gitignore' ELSE '.gitignore (missing)' END AS path FROM missing GROUP BY repo""")
def uncovered(spark, sf):
    lists = sql_table(spark, sf, _IGNORE_LISTS).select("repo", "content")
    repos = sql_table(spark, sf, "SELECT source AS repo FROM {documents} UNION SELECT role AS repo FROM {conversations}")
    return suppression.uncovered_names(repos, lists).select("repo", "pattern", "path")


def _history_sql(rules) -> str:
    parts, n = [], 0
    for r in rules:
        for p in r.match:
            unless = f" AND NOT {oracle.matches('text', r.unless)}" if r.unless else ""
            parts.append(f"SELECT repo, sha, author, committed_at, path, line, {n} AS number, {lit(r.code)} AS code, {lit(r.message)} AS message, {lit({2: 'Error', 1: 'Warning', 0: 'Info'}[r.severity])} AS severity,"
                         f" regexp_extract(text, {lit(oracle.re2(p))}) AS match FROM added WHERE {oracle.matches('text', [p])}{unless}")
            n += 1
    return "leaks AS (SELECT * EXCLUDE (number) FROM (" + "\n UNION ALL ".join(parts) + ") QUALIFY row_number() OVER (PARTITION BY repo, sha, path, line, code ORDER BY number) = 1)"


LEAKS = f"{ADDED}, {_history_sql(history_rules())}"


@query("flt21_history_findings", f"WITH {LEAKS} SELECT repo, sha, path, line, code, severity, match FROM leaks")
def history_findings(spark, sf):
    found = history.history_findings(sql_table(spark, sf, inputs.PATCHES))
    return found.select("repo", "sha", "path", "line", "code", "severity", "match")


@query("flt22_masked_matches", f"WITH {LEAKS} SELECT repo, sha, path, line, code, CASE WHEN length(match) > 80 THEN match[1:77] || '...' ELSE match END AS shown FROM leaks")
def masked(spark, sf):
    found = history.history_findings(sql_table(spark, sf, inputs.PATCHES))
    return found.select("repo", "sha", "path", "line", "code", history.masked(F.col("match")).alias("shown"))
