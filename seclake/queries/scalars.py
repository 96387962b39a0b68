"""Queries over scalar functions, line rewrites and the steps of the taint analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import any_of, java_regex
from ..functions.paths import normal_path, path_bucket
from ..functions.versions import advisory_severity, audit_severity, first_fixed, update_type
from ..operators import dependencies, export, fixes, learning, scope, statistics, taint
from ..operators.matching import line_findings, pick_reminders, scan_rules
from ..plans.scan import editor_scan, findings_with_confidence, with_adaptive_confidence
from ..rules import all_rules
from ..rules.taint import FUNCTION_HEAD, SANITISERS, SINKS, SOURCES
from ..sources import files, policies
from . import corpus, inputs, oracle
from .corpus import duck, lines_sql, lit, sql_table
from .counts import _BUCKET, _LANGS, ACTIONS, STATS, actions
from .filters import _INTERNAL, _LABEL, _SEV
from .joins import _DISMISSED, _SAFE, advisories_of, learned_helpers
from .registry import ORACLES, query
from .sources import IGNORES, update_type_sql

_PLACES = f"places AS ({duck(inputs.PLACES)})"


@query("fn01_normal_path", f"WITH {_PLACES} SELECT repo, replace(replace(path, '/', chr(92)), chr(92), '/') AS path FROM places")
def normal_paths(spark, sf):
    windows = sql_table(spark, sf, inputs.PLACES).withColumn("path", F.translate("path", "/", "\\"))
    return windows.select("repo", normal_path(F.col("path")).alias("path"))


@query("fn02_path_bucket", f"WITH {_PLACES} SELECT repo, path, {_BUCKET} AS bucket FROM places")
def path_buckets(spark, sf):
    return sql_table(spark, sf, inputs.PLACES).select("repo", "path", path_bucket(F.col("path")).alias("bucket"))


_Q = "['\"`]"
_JOINED = lit(rf"{_Q}\s*\+|\+\s*{_Q}|\$\{{")
_CONFIDENCE = f"""leveled AS (SELECT repo, path, language, line, code, CASE
  WHEN code LIKE 'CRED%' OR code LIKE 'AUTH001%' THEN CASE WHEN regexp_matches(trim(text), {lit(rf"=\s*{_Q}[^'" + '"' + rf"`]{{2,}}{_Q}")}) THEN
      CASE WHEN regexp_matches(text, '(?i)process\\.env|os\\.environ|getenv|env\\[') THEN 'verify-needed' ELSE 'critical' END WHEN regexp_matches(text, '=\\s*\\w+') THEN 'verify-needed' END
  WHEN code LIKE 'DB001%' OR code LIKE 'DB002%' THEN CASE WHEN regexp_matches(text, {_JOINED}) THEN 'verify-needed'
      WHEN regexp_matches(text, '\\?\\s*[,)]|\\$\\d+|:\\w+') OR regexp_matches(trim(text), {lit(rf"=\s*{_Q}[^+$]*{_Q}\s*[;,]?\s*$")}) THEN 'safe'
      WHEN EXISTS (SELECT 1 FROM lines n WHERE n.repo = f.repo AND n.path = f.path AND n.line BETWEEN f.line - 2 AND f.line + 2 AND n.line <> f.line AND regexp_matches(n.text, {_JOINED})) THEN 'verify-needed' END
  END AS confidence FROM findings f)"""


def sure_findings(spark, sf):
    """Findings of every rule; those without a confidence have none."""
    return findings_with_confidence(corpus.code(spark, sf), markup=False)


_LEVELS = f"WITH {oracle.findings(all_rules(), corpus.CODE)}, {_CONFIDENCE} SELECT repo, path, line, code, confidence FROM leveled"


@query("fn03_static_confidence", _LEVELS)
@query("fn03_static_confidence_all_rules", _LEVELS)
def confidence(spark, sf):
    return sure_findings(spark, sf).select("repo", "path", "line", "code", "confidence")


_DOWN = lambda c: f"CASE {c} WHEN 'critical' THEN 'verify-needed' WHEN 'verify-needed' THEN 'safe' ELSE {c} END"
_UP = lambda c: f"CASE WHEN {c} IS NULL OR {c} = 'safe' THEN 'verify-needed' WHEN {c} = 'verify-needed' THEN 'critical' ELSE {c} END"


_ADAPTED = f"""WITH {oracle.findings(all_rules(), corpus.CODE)}, {_CONFIDENCE}, {ACTIONS}, {STATS}, {_LANGS},
  j AS (SELECT f.repo, f.path, f.line, f.code, f.confidence, fps + fixed + verified + ignored AS acted, fps::DOUBLE / nullif(fps + fixed + verified, 0) AS fp, (fixed + verified)::DOUBLE / nullif(fps + fixed + verified + ignored, 0) AS fix,
      lang_fixed, lang_fps FROM leveled f LEFT JOIN stats s ON s.code = f.code LEFT JOIN langs l ON l.code = f.code AND l.language = f.language),
  s1 AS (SELECT *, CASE WHEN fp >= 0.7 THEN {_DOWN('confidence')} ELSE confidence END AS c1 FROM j), s2 AS (SELECT *, CASE WHEN fix >= 0.8 THEN {_UP('c1')} ELSE c1 END AS c2 FROM s1),
  s3 AS (SELECT *, CASE WHEN regexp_matches(path, '(?i)test|spec|__tests__|__mocks__') THEN {_DOWN('c2')} ELSE c2 END AS c3 FROM s2),
  s4 AS (SELECT *, CASE WHEN regexp_matches(path, '(?i)[/\\\\](src|lib|app|components?)[/\\\\]') AND lang_fixed + lang_fps >= 3 AND lang_fixed::DOUBLE / (lang_fixed + lang_fps) >= 0.8 THEN {_UP('c3')} ELSE c3 END AS c4 FROM s3)
SELECT repo, path, line, code, CASE WHEN coalesce(acted, 0) >= 5 THEN c4 ELSE confidence END AS confidence FROM s4"""


@query("fn04_adaptive_confidence", _ADAPTED)
@query("fn04_adaptive_confidence_all_rules", _ADAPTED)
def adaptive(spark, sf):
    return with_adaptive_confidence(sure_findings(spark, sf), actions(spark, sf)).select("repo", "path", "line", "code", "confidence")


_VERSIONS = "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'v' ELSE '^' END || (p_size % 4) || '.' || (p_size % 5) || '.' || (p_partkey % 6) AS a, (p_size % 3) || '.' || (p_size % 7) || CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '.' || (p_partkey % 5) END AS b FROM {part}"


@query("fn05_update_type", f"WITH v AS ({duck(_VERSIONS)}) SELECT p_partkey, a, b, {update_type_sql('a', 'b')} AS update_type FROM v")
def update_types(spark, sf):
    v = sql_table(spark, sf, _VERSIONS)
    return v.select("p_partkey", "a", "b", update_type(F.col("a"), F.col("b")).alias("update_type"))


_FEED = f"feed AS (SELECT body::JSON AS b FROM ({duck(inputs.FEED)}))"
_LEVEL = """CASE WHEN (b->>'$.database_specific.severity') = 'CRITICAL' THEN 'critical' WHEN (b->>'$.database_specific.severity') = 'moderate' THEN 'moderate'
  WHEN (b->>'$.severity[0].score') LIKE 'CVSS%' THEN 'high' WHEN (b->'$.severity') IS NOT NULL THEN 'low' ELSE 'unknown' END"""


@query("fn06_advisory_severity", f"WITH {_FEED} SELECT b->>'$.id' AS id, {_LEVEL} AS severity FROM feed")
def advisory_severities(spark, sf):
    a = advisories_of(spark, sf)
    return a.select("id", advisory_severity(F.col("database_specific.severity"), F.transform("severity", lambda s: s["score"])).alias("severity"))


@query("fn07_first_fixed", f"WITH {_FEED} SELECT b->>'$.id' AS id, b->>'$.affected[0].ranges[0].events[1].fixed' AS own, NULL::VARCHAR AS other FROM feed")
def first_fixed_versions(spark, sf):
    a = advisories_of(spark, sf)
    package = F.col("affected")[0]["package"]
    return a.select("id", first_fixed(F.col("affected"), package["name"], package["ecosystem"]).alias("own"),
                    first_fixed(F.col("affected"), F.lit("none"), package["ecosystem"]).alias("other"))


@query("fn08_audit_severity", f"WITH {_FEED}, s AS (SELECT b->>'$.id' AS id, {_LEVEL} AS level FROM feed) SELECT id, level, CASE WHEN level IN ('critical', 'high') THEN 2 WHEN level IN ('moderate', 'unknown') THEN 1 ELSE 0 END AS severity FROM s")
def audit_severities(spark, sf):
    levels = advisory_severities(spark, sf).withColumnRenamed("severity", "level")
    return levels.withColumn("severity", audit_severity(F.col("level")))


_KEPT = ", ".join(lit(k) for k in fixes.KEPT_WORDS)
_ENDS = lit(r"^[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$")
_STRINGS = lit("|".join(rf"{q}[^{q}\\]*(?:\\(?s:.)[^{q}\\]*)*{q}" for q in "'\"`"))
_NUMBERS = lit(r"\b[0-9]+(?:\.[0-9]+)?\b")


def _shape(text: str) -> str:
    """The shape of a line: runs of word characters and dollar signs are cut into names, numbers and dollar signs, and names are numbered."""
    plain = f"regexp_replace(regexp_replace(regexp_replace({text}, {_ENDS}, '', 'g'), {_STRINGS}, '$STRING', 'g'), {_NUMBERS}, '$NUM', 'g')"
    runs = f"regexp_extract_all({plain}, '[\\w$]+|[^\\w$]+')"
    pieces = f"flatten(list_transform({runs}, lambda r: CASE WHEN r IN ('$STRING', '$NUM') OR NOT regexp_matches(r, '^[\\w$]') THEN [r] ELSE regexp_extract_all(r, '[a-zA-Z_](?:[\\w$]*\\w)?|[0-9][\\w$]*|\\$+') END))"
    names = "list_filter(x.pieces, lambda p, i: regexp_matches(p, '^[a-zA-Z_][a-zA-Z0-9_$]*$') AND p NOT IN (%s) AND list_position(x.pieces, p) = i)" % _KEPT
    return (f"list_transform(list_transform([{{'pieces': {pieces}}}], lambda x: {{'pieces': x.pieces, 'names': {names}}}), "
            "lambda y: array_to_string(list_transform(y.pieces, lambda p: CASE WHEN list_contains(y.names, p) THEN '$VAR' || list_position(y.names, p) ELSE p END), ''))[1]")


@query("fn09_normal_lines", f"WITH {corpus.CODE},{lines_sql()} SELECT repo, path, line, {_shape('text')} AS shape FROM lines")
def normal_lines(spark, sf):
    """Lines of derived source files by shape."""
    rows = files.lines(corpus.code(spark, sf))
    return rows.select("repo", "path", "line", fixes.normal_line(F.col("text")).alias("shape"))


_RESTORED = f"""log AS (SELECT DISTINCT repo, code, before, after FROM ({duck(inputs.FIX_LOG)})), shaped AS (SELECT *, {_shape('after')} AS shape, regexp_replace(before, {_ENDS}, '', 'g') AS b FROM log),
  cut AS (SELECT *, list_filter(regexp_extract_all(b, '\\b[a-zA-Z_$][a-zA-Z0-9_$]*\\b'), lambda n: n NOT IN ({_KEPT})) AS vars, regexp_extract_all(b, {_STRINGS}) AS strings, regexp_extract_all(b, {_NUMBERS}) AS nums,
    regexp_extract_all(shape, '\\$(?:VAR[0-9]+|STRING|NUM)|[^$]+|\\$') AS pieces FROM shaped),
  kinds AS (SELECT *, list_transform(pieces, lambda p: CASE WHEN p = '$STRING' THEN 's' WHEN p = '$NUM' THEN 'n' WHEN regexp_matches(p, '^\\$VAR[0-9]+$') THEN 'v' ELSE '' END) AS kinds FROM cut)
SELECT repo, code, before, after, regexp_extract(before, '^\\s*') || array_to_string(list_transform(pieces, lambda p, i: CASE kinds[i]
    WHEN 's' THEN coalesce(strings[len(list_filter(kinds[1:i], lambda k: k = 's'))], '""') WHEN 'n' THEN coalesce(nums[len(list_filter(kinds[1:i], lambda k: k = 'n'))], '0')
    WHEN 'v' THEN coalesce(vars[len(list_filter(kinds[1:i], lambda k: k = 'v'))], '_unknown_') ELSE p END), '') AS restored FROM kinds"""


@query("fn10_restored_lines", f"WITH {_RESTORED}")
def restored_lines(spark, sf):
    log = inputs.fix_log(spark, sf)
    shapes = log.select("repo", "code", "before", "after", fixes.normal_line(F.col("after")).alias("shape")).distinct()
    return shapes.select("repo", "code", "before", "after", fixes.restored_line(F.col("shape"), F.col("before")).alias("restored"))


@query("fn11_helper_names", f"""WITH {ACTIONS} SELECT event_id, array_to_string(list_concat(list_filter([{', '.join(lit(h) for h in learning.KNOWN_HELPERS)}], lambda h: contains(line_text, h)),
  CASE WHEN action = 'false_positive' THEN list_filter(regexp_extract_all(line_text, '([a-zA-Z_$][\\w$.]*)\\s*\\(', 1), lambda c: c NOT IN ('if', 'for', 'while', 'switch', 'function', 'return', 'require', 'import', 'console') AND regexp_matches(c, '(?i)sanitiz|valid|escap|encod|purg|clean|filter|strip')) ELSE [] END), ',') AS helpers FROM actions WHERE line_text IS NOT NULL""")
def helper_names(spark, sf):
    log = actions(spark, sf).where(F.col("line_text").isNotNull())
    names = learning.helper_names(F.col("line_text"), F.col("action") == "false_positive")
    return log.select("event_id", F.array_join(names, ",").alias("helpers"))


_KEYWORDS = ", ".join(lit(k) for k in scope.KEYWORDS)


@query("fn12_identifiers", f"""WITH {corpus.CODE},{lines_sql()}, w AS (SELECT repo, path, line, list_filter(regexp_extract_all(text, '\\b([a-zA-Z_$][\\w$]*)\\b', 1), lambda x: length(x) >= 2 AND x NOT IN ({_KEYWORDS})) AS words FROM lines)
SELECT repo, path, line, array_to_string(list_filter(words, lambda x, i: list_position(words, x) = i), ' ') AS names FROM w""")
def identifier_lists(spark, sf):
    rows = files.lines(corpus.code(spark, sf))
    return rows.select("repo", "path", "line", F.array_join(scope.identifiers(F.col("text")), " ").alias("names"))


@query("fn13_parameters", f"""WITH {corpus.CODE},{lines_sql()}
SELECT repo, path, line, array_to_string(list_filter(list_transform(string_split(regexp_extract(text, '^[^(]*\\(([^)]*)\\)', 1), ','), lambda p: regexp_extract(trim(p), '^(\\w+)', 1)), lambda n: n <> ''), ' ') AS names FROM lines""")
def parameter_lists(spark, sf):
    rows = files.lines(corpus.code(spark, sf))
    return rows.select("repo", "path", "line", F.array_join(scope.parameters(F.col("text")), " ").alias("names"))


_FIXABLE = [r for r in all_rules() if r.code in fixes.REWRITES]


def _replace(code: str, pattern: str, new: str, title: str) -> str:
    return f"WHEN code = '{code}' AND regexp_matches(text, {lit(pattern)}) THEN {{'title': {lit(title)}, 'new_line': regexp_replace(text, {lit(pattern)}, {lit(new)}), 'delete_line': FALSE}}"


def _delete(code: str, pattern: str, title: str) -> str:
    return f"WHEN code = '{code}' AND regexp_matches(text, {lit(pattern)}) THEN {{'title': {lit(title)}, 'new_line': NULL, 'delete_line': TRUE}}"


_FIXES = "CASE " + " ".join([
    _replace("K8S001", r"privileged:\s*true", "privileged: false", "Set privileged: false"), _delete("K8S002", "", "Take the host's network away"),
    _delete("K8S003", r"hostPID:\s*true", "Take the host's processes away"), _delete("K8S003", r"hostIPC:\s*true", "Take the host's memory segments away"),
    _replace("K8S004", r"runAsUser:\s*0\b", "runAsUser: 1000", "Set runAsUser: 1000"),
    _replace("K8S004", r"allowPrivilegeEscalation:\s*true", "allowPrivilegeEscalation: false", "Set allowPrivilegeEscalation: false"),
    _replace("TF002", r'acl\s*=\s*"(?:public-read|public-read-write|authenticated-read)"', 'acl = "private"', "Make the bucket private"),
    _replace("TF004", r"publicly_accessible\s*=\s*true", "publicly_accessible = false", "Set publicly_accessible = false"),
    f"WHEN code = 'JWT002' AND NOT regexp_matches(text, 'algorithms?\\s*:\\s*\\[') AND regexp_matches(text, '\\bjwt\\.verify\\s*\\(\\s*[\\w.]+\\s*,\\s*[\\w.]+\\s*\\)') THEN {{'title': 'Name the algorithm for jwt.verify', 'new_line': regexp_replace(text, '(\\bjwt\\.verify\\s*\\(\\s*[\\w.]+\\s*,\\s*[\\w.]+)(\\s*\\))', '\\1, {{ algorithms: [''RS256''] }}\\2'), 'delete_line': FALSE}}",
    _replace("JWT006", r"\s*,?\s*ignoreExpiration\s*:\s*true\s*,?", "", "Let expired tokens fail"), _replace("JWT006", r"verify_exp\s*=\s*False", "verify_exp=True", "Set verify_exp=True"),
    _replace("DESER003", r"\byaml\.unsafe_load\b", "yaml.safe_load", "Use yaml.safe_load"),
    "WHEN code = 'DESER004' AND NOT regexp_matches(text, 'Loader\\s*=\\s*(?:yaml\\.)?(?:SafeLoader|BaseLoader)') AND regexp_matches(text, '\\byaml\\.load\\s*\\(') THEN {'title': 'Use yaml.safe_load', 'new_line': regexp_replace(text, '\\byaml\\.load\\s*\\(', 'yaml.safe_load('), 'delete_line': FALSE}",
    _replace("ENC004", r"rejectUnauthorized\s*:\s*false", "rejectUnauthorized: true", "Set rejectUnauthorized: true"),
    "WHEN code = 'DOCKER008' AND regexp_matches(text, '(?i)^\\s*HEALTHCHECK\\s+NONE\\b') THEN {'title': 'Turn the missing health check into a comment', 'new_line': regexp_replace(text, '^(\\s*)', '\\1# '), 'delete_line': FALSE}",
    _replace("CORS001", r"""origin\s*:\s*['"]\*['"]""", "origin: false", "Refuse all origins until a list is set"),
]) + " END"


_FIXED = f"""WITH {oracle.findings(_FIXABLE, corpus.CODE)}, x AS (SELECT *, {_FIXES} AS fix FROM findings)
SELECT repo, path, line, code, fix.title AS title, fix.new_line AS new_line, fix.delete_line AS delete_line FROM x WHERE fix IS NOT NULL"""


@query("fn14_proposed_fixes", _FIXED)
@query("fn14_proposed_fixes_all_rules", _FIXED)
def proposed_fixes(spark, sf):
    """Fixes for the findings of every rule that has one."""
    found = pick_reminders(line_findings(corpus.code(spark, sf), _FIXABLE))
    return fixes.proposed_fixes(found).select("repo", "path", "line", "code", "title", "new_line", "delete_line")


@query("fn04_editor_scan", f"""WITH {oracle.findings(all_rules(), corpus.CODE, markup=True)}, {_CONFIDENCE} SELECT f.repo, f.path, f.line, f.code, f.severity, l.confidence FROM findings f JOIN leveled l USING (repo, path, line, code)""")
def editor(spark, sf):
    """The editor's scan without learned state: findings with their confidence."""
    return editor_scan(corpus.code(spark, sf)).select("repo", "path", "line", "code", "severity", "confidence")


_EDITED = oracle.findings(all_rules(), f"new_files AS ({duck(inputs.EDITED, 'files')})", "new_", markup=True)
_NEW_CONFIDENCE = _CONFIDENCE.replace("FROM findings f", "FROM new_findings f").replace("FROM lines n", "FROM new_lines n")
_STEPS = _ADAPTED[_ADAPTED.index(ACTIONS) : _ADAPTED.rindex("\nSELECT")]
_WHOLE_EDITOR = f"""WITH {inputs.FINDINGS}, {_EDITED}, {_NEW_CONFIDENCE}, {_STEPS}, {_DISMISSED}, {IGNORES}, safe AS ({duck(_SAFE)}),
  shown AS (SELECT f.*, CASE WHEN coalesce(acted, 0) >= 5 THEN c4 ELSE s.confidence END AS confidence FROM new_findings f JOIN s4 s ON s.repo = f.repo AND s.path = f.path AND s.line = f.line AND s.code = f.code)
SELECT repo, path, line, code, CASE WHEN severity = 1 AND {_INTERNAL} THEN 0 ELSE severity END AS severity, confidence FROM shown f WHERE severity <> 0
  AND NOT EXISTS (SELECT 1 FROM safe s JOIN new_lines n ON n.repo = s.repo WHERE s.observed >= 2 AND s.repo = f.repo AND starts_with(f.code, s.prefix) AND n.path = f.path AND n.line BETWEEN f.line - 3 AND f.line + 3 AND contains(n.text, s.helper))
  AND NOT EXISTS (SELECT 1 FROM ignores i WHERE i.repo = f.repo AND i.code = f.code AND i.path = f.path AND (i.line IS NULL OR i.line = f.line + 1))
  AND NOT EXISTS (SELECT 1 FROM dismissals d JOIN new_files n ON n.repo = d.repo AND n.path = d.path AND n.content = d.old WHERE d.repo = f.repo AND d.path = f.path AND d.code = f.code AND d.line = f.line AND d.pattern = f.pattern)"""


@query("fn04_editor_scan_all_rules", _WHOLE_EDITOR)
def editor_all(spark, sf):
    """The editor's scan of the edited files with every rule, all learned state and both severity toggles.

    Dismissals were made on the first version of the files, by every rule whose finding is no error.
    """
    before, now = corpus.code(spark, sf), inputs.new_files(spark, sf)
    hashes = lambda t: t.select("repo", "path", files.content_hash(F.col("content")).alias("content_hash"))
    dismissed = scan_rules(before, all_rules()).where(F.col("severity") != 2).select("repo", "path", "code", "line", "pattern").join(hashes(before), ["repo", "path"])
    ignores = policies.ignore_entries(sql_table(spark, sf, inputs.IGNORE_FILES))
    found = editor_scan(now, ignores=ignores, dismissals=dismissed, hashes=hashes(now), safe=learned_helpers(spark, sf), actions=actions(spark, sf), show_info=False, reduce_internal=True)
    return found.select("repo", "path", "line", "code", "severity", "confidence")


@query("fn15_export_labels", f"WITH {inputs.FINDINGS} SELECT repo, path AS file, line + 1 AS line, col + 1 AS column, {_SEV} AS severity, code, {_LABEL} AS category FROM findings")
def export_labels(spark, sf):
    return export.exported(inputs.findings(spark, sf)).drop("message", "suggestion", "pattern")


_CSV = f"""csv AS (SELECT repo, '"' || replace(path, '"', '""') || '",' || (line + 1) || ',' || (col + 1) || ',' || {_SEV} || ',' || code || ',"' || {_LABEL} || '","' || replace(message, '"', '""') || '","' || replace(suggestion, '"', '""') || '"' AS line_text FROM findings)"""


@query("fn16_csv_lines", f"WITH {inputs.FINDINGS}, {_CSV} SELECT * FROM csv")
def csv_lines(spark, sf):
    return export.csv_rows(inputs.findings(spark, sf))


@query("fn17_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hashes(spark, sf):
    return corpus.table(spark, sf, "documents").select("doc_id", files.content_hash(F.col("text")).alias("hash"))


_STACK = "SELECT 'team' || c_nationkey AS repo, CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'Node.js' WHEN 1 THEN 'TypeScript' ELSE 'Engine' END AS component, c_custkey, (c_custkey % 3) || '.' || (c_nationkey % 4) || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '.1' END AS current FROM {customer}"
_LATEST = "SELECT DISTINCT CASE n_regionkey WHEN 0 THEN 'Node.js' WHEN 1 THEN 'TypeScript' ELSE 'Runtime' END AS component, '1.2.1' AS latest FROM {nation}"


@query("fn19_stack_drift", f"""WITH s AS ({duck(_STACK)}), l AS ({duck(_LATEST)}), j AS (SELECT repo, s.component, current, latest, {update_type_sql('current', "coalesce(latest, '')")} AS t, s.component = 'Node.js' AND coalesce(latest, '') <> '' AND current <> latest AS differs FROM s LEFT JOIN l ON l.component = s.component)
SELECT repo, component, current, latest, t <> 'unknown' OR differs AS is_outdated, CASE WHEN t <> 'unknown' THEN t WHEN differs THEN 'major' ELSE 'up-to-date' END AS update_type FROM j""")
def stack_drift(spark, sf):
    return dependencies.stack_drift(sql_table(spark, sf, _STACK).drop("c_custkey"), sql_table(spark, sf, _LATEST))


_SHOWN = f"""WITH {oracle.findings(all_rules(), corpus.CODE)}, {_CONFIDENCE} SELECT f.repo, f.path, f.line, f.code, CASE confidence WHEN 'critical' THEN '[Critical] ' WHEN 'safe' THEN '[Safe] ' WHEN 'verify-needed' THEN '[Verify Needed] ' ELSE '' END
  || '[' || {_LABEL} || '] ' || f.code || ': ' || message AS shown FROM findings f JOIN leveled l ON l.repo = f.repo AND l.path = f.path AND l.line = f.line AND l.code = f.code"""


@query("fn20_display_text", _SHOWN)
@query("fn20_display_text_all_rules", _SHOWN)
def display(spark, sf):
    shown = statistics.display_text(F.col("code"), F.col("category"), F.col("message"), F.col("confidence"))
    return sure_findings(spark, sf).select("repo", "path", "line", "code", shown.alias("shown"))


@query("tnt01_function_heads", f"WITH {corpus.CODE},{lines_sql()} SELECT repo, path, line FROM lines WHERE {oracle.matches('text', [FUNCTION_HEAD])}")
def function_heads(spark, sf):
    return files.lines(corpus.code(spark, sf)).where(F.col("text").rlike(java_regex(FUNCTION_HEAD))).select("repo", "path", "line")


# Braces of a file in order, with running depth; a head closes at the first return to its own depth.
@query("tnt02_function_ranges", f"""WITH {corpus.CODE},{lines_sql()},
  b AS (SELECT repo, path, line, unnest(regexp_extract_all(text, '[{{}}]')) AS t, generate_subscripts(regexp_extract_all(text, '[{{}}]'), 1) AS k FROM lines),
  d AS (SELECT *, row_number() OVER w AS i, sum(CASE t WHEN '{{' THEN 1 ELSE -1 END) OVER w AS depth FROM b WINDOW w AS (PARTITION BY repo, path ORDER BY line, k ROWS UNBOUNDED PRECEDING)),
  h AS (SELECT repo, path, line AS start FROM lines WHERE {oracle.matches('text', [FUNCTION_HEAD])}),
  base AS (SELECT h.*, coalesce((SELECT max_by(depth, i) FROM d WHERE d.repo = h.repo AND d.path = h.path AND d.line < h.start), 0) AS before, (SELECT min(i) FROM d WHERE d.repo = h.repo AND d.path = h.path AND d.line >= h.start AND t = '{{') AS opens FROM h)
SELECT b.repo, b.path, b.start, min_by(d.line, d.i) AS stop FROM base b JOIN d ON d.repo = b.repo AND d.path = b.path AND d.i > b.opens AND d.t = '}}' AND d.depth = b.before GROUP BY ALL""")
def function_ranges(spark, sf):
    return scope.functions(corpus.code(spark, sf)).select("repo", "path", "start", "stop")


# The same ranges answer two of the join queries.
ORACLES["jn13_function_ranges"] = ORACLES["tnt02_function_ranges"]
ORACLES["jn13_enclosing_functions"] = f"""WITH {inputs.FINDINGS}, ranges AS ({ORACLES["tnt02_function_ranges"]}),
  inside AS (SELECT f.repo, f.path, f.line, max(start) AS start FROM (SELECT DISTINCT repo, path, line FROM findings) f JOIN ranges r ON r.repo = f.repo AND r.path = f.path AND f.line BETWEEN r.start AND r.stop GROUP BY ALL)
SELECT f.repo, f.path, f.code, f.line, f.pattern, i.start, r.stop FROM findings f LEFT JOIN inside i ON i.repo = f.repo AND i.path = f.path AND i.line = f.line LEFT JOIN ranges r ON r.repo = i.repo AND r.path = i.path AND r.start = i.start"""

_LABELS = lambda c: "CASE " + " ".join(f"WHEN {oracle.matches(c, [s.expr])} THEN {lit(s.label)}" for s in SOURCES) + " END"
_DECL = r"(?:^|\s)(?:const|let|var)\s+(\{[^}]+\}|\[[^\]]+\]|[\w$]+)\s*=\s*(.+);?$"
_SET = r"^\s*([\w$]+)\s*=\s*(.+);?$"


@query("tnt03_tainting_assignments", f"""WITH {corpus.CODE},{lines_sql()}, c AS (SELECT repo, path, line, regexp_extract(text, {lit(_DECL)}, 1) AS n1, regexp_extract(text, {lit(_DECL)}, 2) AS r1, regexp_extract(text, {lit(_SET)}, 1) AS n2, regexp_extract(text, {lit(_SET)}, 2) AS r2 FROM lines),
  l AS (SELECT *, CASE WHEN regexp_matches(n1, '^[\\w$]+$') THEN {_LABELS('r1')} END AS l1, CASE WHEN n2 <> '' THEN {_LABELS('r2')} END AS l2 FROM c)
SELECT repo, path, line, CASE WHEN l1 IS NOT NULL THEN n1 ELSE n2 END AS name, coalesce(l1, l2) AS label FROM l WHERE coalesce(l1, l2) IS NOT NULL""")
def tainting_assignments(spark, sf):
    rows = files.lines(corpus.code(spark, sf)).withColumn("a", taint.tainting_assignment(F.col("text")))
    return rows.where(F.col("a").isNotNull()).select("repo", "path", "line", "a.name", "a.label")


@query("tnt04_sanitiser_lines", f"WITH {corpus.CODE},{lines_sql()} SELECT repo, path, line FROM lines WHERE {oracle.matches('text', SANITISERS)}")
def sanitiser_lines(spark, sf):
    return files.lines(corpus.code(spark, sf)).where(F.col("text").rlike(any_of(SANITISERS))).select("repo", "path", "line")


_CALLS = "\n UNION ALL ".join(
    f"SELECT repo, path, line, {n} AS sink, regexp_extract(text, {lit('(?s)^.*?(?:' + k.call.text + ')(.*)$')}, 1) AS rest FROM lines WHERE {oracle.matches('text', [k.call])}"
    for n, k in enumerate(SINKS)
)
_CALLED = f"""calls AS ({_CALLS}),
  marks AS (SELECT *, unnest(string_split(rest, '')) AS ch, generate_subscripts(string_split(rest, ''), 1) AS i FROM calls),
  depths AS (SELECT *, 1 + sum(CASE ch WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY repo, path, line, sink ORDER BY i ROWS UNBOUNDED PRECEDING) AS depth FROM marks),
  closes AS (SELECT repo, path, line, sink, min(i) AS stop FROM depths WHERE depth = 0 GROUP BY ALL),
  cut AS (SELECT c.repo, c.path, c.line, c.sink, CASE WHEN stop IS NULL THEN rest ELSE rest[1:stop - 1] END AS args FROM calls c LEFT JOIN closes USING (repo, path, line, sink)),
  called AS (SELECT *, {_LABELS('args')} AS direct FROM cut)"""


@query("tnt06_sink_calls", f"WITH {corpus.CODE},{lines_sql()}, {_CALLED} SELECT repo, path, line, sink, args, direct FROM called")
def sink_calls(spark, sf):
    """Sinks on each line with their arguments and the source they name directly."""
    rows = files.lines(corpus.code(spark, sf)).where(F.col("text").rlike(any_of([s.call for s in SINKS])))
    calls = rows.select("repo", "path", "line", F.explode(taint.sink_calls(F.col("text"))).alias("s"))
    return calls.select("repo", "path", "line", "s.sink", "s.args", "s.direct")


_WORD = lambda text, name: f"regexp_matches({text}, '\\b' || replace({name}, '$', '\\$') || '\\b')"
# A variable counts at a line when it was tainted there or before, inside the function, and no line since
# then (up to and including this one) both cleans and names it. Variables are tried by age.
TAINT = f"""assigned AS ({ORACLES["tnt03_tainting_assignments"]}), ranges AS ({ORACLES["tnt02_function_ranges"]}), cleaners AS (SELECT repo, path, line, text FROM lines WHERE {oracle.matches('text', SANITISERS)}),
  {_CALLED},
  visits AS (SELECT r.start, r.stop, c.* FROM ranges r JOIN called c ON c.repo = r.repo AND c.path = r.path AND c.line BETWEEN r.start AND r.stop
      WHERE NOT EXISTS (SELECT 1 FROM assigned a WHERE a.repo = c.repo AND a.path = c.path AND a.line = c.line)),
  named AS (SELECT v.repo, v.path, v.start, v.line, v.sink, a.name, a.line AS came, a.label,
        (SELECT max(k.line) FROM cleaners k WHERE k.repo = v.repo AND k.path = v.path AND k.line BETWEEN v.start AND v.line AND {_WORD('k.text', 'a.name')}) AS cleaned
      FROM visits v JOIN assigned a ON a.repo = v.repo AND a.path = v.path AND a.line >= v.start AND a.line < v.line WHERE {_WORD('v.args', 'a.name')}),
  alive AS (SELECT repo, path, start, line, sink, name, min(came) AS born, max(came) AS source_line, max_by(label, came) AS label FROM named WHERE cleaned IS NULL OR came >= cleaned GROUP BY ALL),
  eldest AS (SELECT * FROM alive QUALIFY row_number() OVER (PARTITION BY repo, path, start, line, sink ORDER BY born) = 1),
  reached AS (SELECT v.repo, v.path, v.start, v.line, v.sink, CASE WHEN v.direct IS NULL THEN e.name END AS name, CASE WHEN v.direct IS NULL THEN e.source_line END AS source_line, coalesce(v.direct, e.label) AS label
      FROM visits v LEFT JOIN eldest e ON e.repo = v.repo AND e.path = v.path AND e.start = v.start AND e.line = v.line AND e.sink = v.sink WHERE v.direct IS NOT NULL OR e.name IS NOT NULL),
  tainted AS (SELECT DISTINCT repo, path, line, sink, name, source_line, label FROM (SELECT * FROM reached QUALIFY row_number() OVER (PARTITION BY repo, path, start, line ORDER BY sink) = 1)),
  sinks(sink, code, category, what, call) AS (VALUES {", ".join(f"({i}, {lit(k.code)}, {lit(k.category)}, {lit(k.message)}, {lit(k.call.text)})" for i, k in enumerate(SINKS))}),
  taint_findings AS (SELECT repo, path, line, code, category, 2 AS severity, CASE WHEN name IS NULL THEN what || ': the argument itself is ' || label
      ELSE what || ': `' || name || '` holds ' || label || ' since line ' || (source_line + 1) END AS message, call AS pattern FROM tainted JOIN sinks USING (sink))"""
_TAINT = f"{corpus.CODE},{lines_sql()}, {TAINT}"
ORACLES["jn14_taint_as_of"] = f"WITH {_TAINT} SELECT repo, path, line, sink, name, source_line, label FROM tainted WHERE name IS NOT NULL"
for _name, _files in (("code", corpus.CODE), ("documents", corpus.DOCUMENTS), ("pages", corpus.PAGES), ("conversations", corpus.CONVERSATIONS)):
    ORACLES[f"scan_{_name}_all_rules"] = f"""WITH {oracle.findings(all_rules(), corpus.CODE)}, {TAINT} SELECT repo, path, line, col, code, severity, category, pattern FROM findings
UNION ALL SELECT repo, path, line, 0 AS col, code, severity, category, pattern FROM taint_findings""".replace(corpus.CODE, _files)
ORACLES["sql01_findings_view"] = f"""WITH {oracle.findings(all_rules(), corpus.CODE)}, {TAINT}, every AS (SELECT repo, path, code, severity FROM findings UNION ALL SELECT repo, path, code, severity FROM taint_findings)
SELECT e.repo, e.code, e.severity, count(*) AS found FROM every e JOIN files f ON f.repo = e.repo AND f.path = e.path WHERE f.language = 'javascript' AND e.path LIKE 'src/%' GROUP BY ALL"""
ORACLES["set01_all_findings"] = f"""WITH {inputs.FINDINGS}, {TAINT} SELECT repo, path, line, code, severity, pattern FROM findings
UNION ALL SELECT repo, path, line, code, severity, pattern FROM taint_findings"""


@query("tnt05_tainted_variables", f"WITH {_TAINT} SELECT repo, name, label, count(*) AS uses FROM tainted WHERE name IS NOT NULL GROUP BY ALL")
def tainted_variables(spark, sf):
    hits = taint.taint_hits(corpus.code(spark, sf)).where(F.col("name").isNotNull())
    return hits.groupBy("repo", "name", "label").agg(F.count("*").alias("uses"))


@query("tnt07_taint_findings", f"WITH {_TAINT} SELECT repo, path, line, code, severity, message FROM taint_findings")
def taint_findings(spark, sf):
    return taint.taint_findings(corpus.code(spark, sf)).select("repo", "path", "line", "code", "severity", "message")


_HEAD_NAMES = "list_filter(list_transform(string_split(regexp_extract(h.text, '^[^(]*\\(([^)]*)\\)', 1), ','), lambda p: regexp_extract(trim(p), '^(\\w+)', 1)), lambda n: n <> '')"
_DECLARES = "'(?:const|let|var)\\s+' || replace(name, '$', '\\$') || '\\b'"
ORACLES["jn15_definitions"] = f"""WITH {_TAINT},
  inside AS (SELECT f.repo, f.path, f.line, max(r.start) AS start FROM (SELECT DISTINCT repo, path, line FROM taint_findings) f JOIN ranges r ON r.repo = f.repo AND r.path = f.path AND f.line BETWEEN r.start AND r.stop GROUP BY ALL),
  placed AS (SELECT f.repo, f.path, f.line, f.code, i.start, r.stop, l.text FROM taint_findings f JOIN inside i USING (repo, path, line) JOIN ranges r ON r.repo = i.repo AND r.path = i.path AND r.start = i.start
      JOIN lines l ON l.repo = f.repo AND l.path = f.path AND l.line = f.line),
  words AS (SELECT * EXCLUDE (text), unnest(list_distinct(list_filter(regexp_extract_all(text, '\\b([a-zA-Z_$][\\w$]*)\\b', 1), lambda x: length(x) >= 2 AND x NOT IN ({_KEYWORDS})))) AS name FROM placed),
  found AS (SELECT w.*, list_contains({_HEAD_NAMES}, name) AS given,
      (SELECT max(b.line) FROM lines b WHERE b.repo = w.repo AND b.path = w.path AND b.line >= w.start AND b.line < w.line AND regexp_matches(b.text, {_DECLARES} || '|\\b' || replace(name, '$', '\\$') || '\\s*=')) AS earlier,
      (SELECT min(a.line) FROM lines a WHERE a.repo = w.repo AND a.path = w.path AND a.line > w.line AND a.line <= w.stop AND regexp_matches(a.text, {_DECLARES})) AS later
    FROM words w JOIN lines h ON h.repo = w.repo AND h.path = w.path AND h.line = w.start),
  told AS (SELECT *, CASE WHEN given THEN 'parameter' WHEN earlier IS NOT NULL THEN 'before' WHEN later IS NOT NULL THEN 'after' END AS kind, CASE WHEN given THEN start ELSE coalesce(earlier, later) END AS definition_line FROM found)
SELECT t.repo, t.path, t.line, t.code, t.name, t.kind, t.definition_line, trim(d.text) AS definition_text FROM told t JOIN lines d ON d.repo = t.repo AND d.path = t.path AND d.line = t.definition_line WHERE kind IS NOT NULL"""
