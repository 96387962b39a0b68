"""Queries over suppression, baselines, status, diffs, regressions, packages and scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dependencies, fixes, lifecycle, scope, suppression, taint, tasks
from ..operators.matching import line_findings, pick_reminders
from ..plans.workspace import written
from ..sources import files as file_source
from ..sources import manifests, policies, reports
from . import corpus, inputs
from .corpus import duck, sql_table
from .registry import ORACLES, query
from .sources import AUDIT, BASELINE, IGNORES, OUTDATED, REPORTS_SQL

KEY = ["repo", "path", "code", "line", "pattern"]
_KEY = ", ".join(KEY)


@query("jn01_without_ignored", f"""WITH {inputs.FINDINGS}, {IGNORES} SELECT {_KEY} FROM findings f WHERE NOT EXISTS (
  SELECT 1 FROM ignores i WHERE i.repo = f.repo AND i.code = f.code AND i.path = f.path AND (i.line IS NULL OR i.line = f.line + 1))""")
def without_ignored(spark, sf):
    ignores = policies.ignore_entries(sql_table(spark, sf, inputs.IGNORE_FILES))
    return suppression.without_ignored(inputs.findings(spark, sf), ignores).select(*KEY)


@query("jn01_without_ignored_wildcard", f"""WITH {inputs.FINDINGS}, {IGNORES} SELECT {_KEY} FROM findings f WHERE NOT EXISTS (
  SELECT 1 FROM ignores i WHERE i.repo = f.repo AND i.code = f.code AND i.path IN (f.path, '*') AND (i.line IS NULL OR i.line = f.line + 1))""")
def without_ignored_wildcard(spark, sf):
    ignores = policies.ignore_entries(sql_table(spark, sf, inputs.IGNORE_FILES))
    return suppression.without_ignored(inputs.findings(spark, sf), ignores, wildcard=True).select(*KEY)


# A dismissal per finding of the first version, made on its content.
def _dismissals(spark, sf):
    hashes = corpus.code(spark, sf).select("repo", "path", file_source.content_hash(F.col("content")).alias("content_hash"))
    return inputs.findings(spark, sf).where(F.col("severity") != 2).select(*KEY).join(hashes, ["repo", "path"])


def _new_hashes(spark, sf):
    return inputs.new_files(spark, sf).select("repo", "path", file_source.content_hash(F.col("content")).alias("content_hash"))


_DISMISSED = """dismissals AS (SELECT f.repo, f.path, f.code, f.line, f.pattern, c.content AS old FROM findings f JOIN files c ON c.repo = f.repo AND c.path = f.path WHERE f.severity <> 2)"""


@query("jn02_without_dismissed", f"""WITH {inputs.FINDINGS}, {inputs.NEW_FINDINGS}, {_DISMISSED}
SELECT {_KEY} FROM new_findings f WHERE NOT EXISTS (SELECT 1 FROM dismissals d JOIN new_files n ON n.repo = d.repo AND n.path = d.path AND n.content = d.old
  WHERE d.repo = f.repo AND d.path = f.path AND d.code = f.code AND d.line = f.line AND d.pattern = f.pattern)""")
def without_dismissed(spark, sf):
    found = suppression.without_dismissed(inputs.new_findings(spark, sf), _dismissals(spark, sf), _new_hashes(spark, sf))
    return found.select(*KEY)


@query("jn03_outdated_dismissals", f"""WITH {inputs.FINDINGS}, new_files AS ({duck(inputs.EDITED, 'files')}), {_DISMISSED}
SELECT {_KEY} FROM dismissals d WHERE EXISTS (SELECT 1 FROM new_files n WHERE n.repo = d.repo AND n.path = d.path AND n.content <> d.old)""")
def outdated_dismissals(spark, sf):
    return suppression.outdated_dismissals(_dismissals(spark, sf), _new_hashes(spark, sf)).select(*KEY)


@query("jn04_apply_baseline", f"""WITH {inputs.FINDINGS}, {BASELINE}
SELECT f.repo, f.path, f.code, f.line, f.pattern, row_number() OVER (PARTITION BY f.repo, f.path, f.code ORDER BY f.line, f.col, f.pattern) <= coalesce(b.n, 0) AS baselined
FROM findings f LEFT JOIN baseline b ON b.repo = f.repo AND b.path = f.path AND b.code = f.code""")
def apply_baseline(spark, sf):
    baseline = policies.baseline_entries(sql_table(spark, sf, inputs.BASELINE_FILES))
    return suppression.apply_baseline(inputs.findings(spark, sf), baseline).select(*KEY, "baselined")


# Learned helpers: names in findings' surroundings, trusted by count.
_SAFE = """SELECT source AS repo, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'session' WHEN 1 THEN 'hostPID' WHEN 2 THEN 'credentials' ELSE 'refund' END AS helper,
  CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'AUTH' WHEN 1 THEN 'K8S001' WHEN 2 THEN 'CORS00' ELSE 'BIZ' END AS prefix, COUNT(*) AS observed FROM {documents} GROUP BY 1, 2, 3"""


def learned_helpers(spark, sf):
    return sql_table(spark, sf, _SAFE).select(
        "repo", F.col("helper").alias("function"), F.array("prefix").alias("codes"), "observed", F.lit(0.6).alias("confidence")
    )


@query("jn05_learned_suppression", f"""WITH {inputs.FINDINGS}, safe AS ({duck(_SAFE)})
SELECT {_KEY} FROM findings f WHERE NOT EXISTS (SELECT 1 FROM safe s JOIN lines n ON n.repo = s.repo WHERE s.observed >= 2 AND s.repo = f.repo AND starts_with(f.code, s.prefix)
  AND n.path = f.path AND n.line BETWEEN f.line - 3 AND f.line + 3 AND contains(n.text, s.helper))""")
def learned_suppression(spark, sf):
    safe, codes = learned_helpers(spark, sf), [r.code for r in inputs.RULES]
    judge = lambda hits: suppression.helpers_nearby(hits, safe, codes)
    found = pick_reminders(line_findings(corpus.code(spark, sf), inputs.RULES, keep_near=True, judge=judge)).select(*KEY, "covered")
    return suppression.learned_suppression(found)


@query("jn06_status_overlay", f"WITH {inputs.NEW_FINDINGS_ALL}, {inputs.STATUS_SQL} SELECT f.repo, f.path, f.code, f.line, f.pattern, coalesce(s.status, 'pending') AS status FROM new_findings f LEFT JOIN statuses s USING ({_KEY})")
def status_overlay(spark, sf):
    return lifecycle.with_status(inputs.new_findings(spark, sf).select(*KEY), inputs.statuses(spark, sf)).select(*KEY, "status")


@query("jn07_scan_diff", f"""WITH {inputs.NEW_FINDINGS_ALL}
SELECT *, 'resolved' AS change FROM (SELECT {_KEY} FROM findings EXCEPT SELECT {_KEY} FROM new_findings) UNION ALL SELECT *, 'new' FROM (SELECT {_KEY} FROM new_findings EXCEPT SELECT {_KEY} FROM findings)""")
def scan_diff(spark, sf):
    return lifecycle.scan_diff(inputs.stored_findings(spark, sf), inputs.stored_new_findings(spark, sf))


@query("jn08_auto_verify", f"""WITH {inputs.NEW_FINDINGS_ALL}, {inputs.STATUS_SQL}, gone AS (SELECT {_KEY} FROM findings EXCEPT SELECT {_KEY} FROM new_findings)
SELECT {_KEY} FROM gone g WHERE (g.line = 0 OR NOT EXISTS (SELECT 1 FROM new_findings n WHERE n.repo = g.repo AND n.path = g.path AND n.code = g.code AND n.pattern = g.pattern))
  AND NOT EXISTS (SELECT 1 FROM statuses s WHERE s.status IN ('verified', 'ignored') AND s.repo = g.repo AND s.path = g.path AND s.code = g.code AND s.line = g.line AND s.pattern = g.pattern)""")
def auto_verify(spark, sf):
    old, new = inputs.stored_findings(spark, sf), inputs.stored_new_findings(spark, sf)
    return lifecycle.auto_verified(old, new, inputs.statuses(spark, sf, old))


@query("jn09_verify_fixes", f"""WITH {inputs.NEW_FINDINGS_ALL}, {inputs.STATUS_SQL}
SELECT {_KEY}, CASE WHEN EXISTS (SELECT 1 FROM new_findings n WHERE n.repo = s.repo AND n.path = s.path AND n.code = s.code AND n.line = s.line) THEN 'still-present' ELSE 'verified' END AS outcome FROM statuses s WHERE status = 'fixed'""")
def verify_fixes(spark, sf):
    return lifecycle.verify_fixes(inputs.statuses(spark, sf), inputs.new_findings(spark, sf))


_KNOWN = "SELECT repo, path, code, line FROM {findings} WHERE code IN ('AUTH003', 'K8S002')"


@query("jn10_regressions", f"""WITH {inputs.NEW_FINDINGS_ALL}, {inputs.STATUS_SQL}, known AS ({duck(_KNOWN, 'findings')})
SELECT DISTINCT f.repo, f.path, f.code, f.line FROM new_findings f JOIN statuses s ON s.status = 'verified' AND s.repo = f.repo AND s.path = f.path AND s.code = f.code
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.repo = f.repo AND k.path = f.path AND k.code = f.code AND k.line = f.line)""")
def regressions(spark, sf):
    old = inputs.stored_findings(spark, sf)
    known = sql_table(spark, sf, _KNOWN, findings=old)
    return lifecycle.regressions(inputs.new_findings(spark, sf), inputs.statuses(spark, sf, old), known).select("repo", "path", "code", "line")


def packages_of(spark, sf):
    """Packages, parsed once and stored: the join with advisories reads them twice."""
    return written(manifests.packages(sql_table(spark, sf, inputs.MANIFESTS)))


def advisories_of(spark, sf):
    return reports.parse_advisories(sql_table(spark, sf, inputs.FEED))


_PARTS = [("src16_requirements", "requirements.txt"), ("src17_go_mod", "go.mod"), ("src18_cargo_lock", "Cargo.lock"), ("src19_cargo_toml", "Cargo.toml"),
          ("src20_pom", "pom.xml"), ("src21_gemfile_lock", "Gemfile.lock"), ("src22_composer_lock", "composer.lock")]
_REFERENCES = " UNION ALL ".join(f"SELECT *, '{file}' AS manifest FROM ({ORACLES[key]})" for key, file in _PARTS)
_RANK = "CASE manifest WHEN 'requirements.txt' THEN 0 WHEN 'go.mod' THEN 1 WHEN 'Cargo.lock' THEN 2 WHEN 'Cargo.toml' THEN 3 WHEN 'pom.xml' THEN 4 WHEN 'Gemfile.lock' THEN 5 ELSE 6 END"


def _version(v: str) -> str:
    """A list that orders versions: six numbers, then 0 for a pre-release."""
    core = f"regexp_extract({v}, '^([0-9]+(?:\\.[0-9]+)*)', 1)"
    return f"list_concat(list_resize(list_transform(string_split({core}, '.'), lambda x: CAST(x AS BIGINT)), 6, 0::BIGINT), [CASE WHEN length({v}) > length({core}) THEN 0 ELSE 1 END::BIGINT])"


VULNERABLE = f"""refs AS ({_REFERENCES}),
  kept AS (SELECT * FROM refs r WHERE NOT (manifest = 'Cargo.toml' AND EXISTS (SELECT 1 FROM refs o WHERE o.manifest = 'Cargo.lock' AND o.repo = r.repo AND o.dir = r.dir))),
  packages AS (SELECT repo, dir, ecosystem, name, version, arg_min(manifest, {_RANK}) AS manifest FROM kept GROUP BY ALL),
  feed AS (SELECT body::JSON AS b FROM ({duck(inputs.FEED)})),
  adv AS (SELECT b->>'$.id' AS id, b->>'$.affected[0].package.name' AS name, b->>'$.affected[0].package.ecosystem' AS ecosystem, CAST(b->'$.affected[0].versions' AS VARCHAR[]) AS versions,
      b->>'$.affected[0].ranges[0].events[1].fixed' AS fixed_version, coalesce(nullif(b->>'$.summary', ''), b->>'$.details') AS summary,
      CASE WHEN (b->>'$.database_specific.severity') = 'CRITICAL' THEN 'critical' WHEN (b->>'$.database_specific.severity') = 'moderate' THEN 'moderate' WHEN (b->>'$.severity[0].score') LIKE 'CVSS%' THEN 'high'
           WHEN (b->'$.severity') IS NOT NULL THEN 'low' ELSE 'unknown' END AS severity FROM feed),
  vulnerable AS (SELECT p.repo, p.dir, p.manifest, p.ecosystem, p.name, p.version, a.id, a.severity, a.summary, a.fixed_version, 'https://osv.dev/vulnerability/' || a.id AS url
      FROM packages p JOIN adv a ON a.ecosystem = p.ecosystem AND a.name = p.name
      WHERE list_contains(a.versions, p.version) OR {_version("p.version")} < {_version("a.fixed_version")})"""


@query("jn11_vulnerable_packages", f"WITH {VULNERABLE} SELECT * FROM vulnerable")
def vulnerable(spark, sf):
    found = dependencies.vulnerable_packages(packages_of(spark, sf), advisories_of(spark, sf))
    return found.select("repo", "dir", "manifest", "ecosystem", "name", "version", "id", "severity", "summary", "fixed_version", "url")


@query("jn12_fix_lookup")
def fix_lookup(spark, sf):
    """The best proven fix for each line of the log, by line shape."""
    log = inputs.fix_log(spark, sf)
    lines = log.select("repo", "code", "language", F.col("before").alias("text")).distinct()
    found = fixes.matching_fixes(lines, fixes.learned_fixes(log))
    return found.select("repo", "code", "language", "text", "suggested", F.round("success_rate", 6).alias("success_rate"))


@query("jn13_function_ranges")
def function_ranges(spark, sf):
    return scope.functions(corpus.code(spark, sf)).select("repo", "path", "start", "stop")


@query("jn13_enclosing_functions")
def enclosing(spark, sf):
    files = corpus.code(spark, sf)
    return scope.enclosing_functions(inputs.findings(spark, sf).select(*KEY), files).select(*KEY, "start", "stop")


@query("jn14_taint_as_of")
def taint_as_of(spark, sf):
    """Variables still tainted at a sink, with the line that tainted them last."""
    hits = taint.taint_hits(corpus.code(spark, sf)).where(F.col("name").isNotNull())
    return hits.select("repo", "path", "line", "sink", "name", "source_line", "label")


@query("jn15_definitions")
def definitions(spark, sf):
    files = corpus.code(spark, sf)
    found = taint.taint_findings(files)
    return scope.definitions(found, files).select("repo", "path", "line", "code", "name", "kind", "definition_line", "definition_text")


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


_TRIGGERS = "SELECT 'team' || (user_id % 5) AS repo, CASE WHEN event_type = 'view' THEN 'workspace-scan' WHEN event_type = 'click' THEN 'dependency-check' ELSE 'full-scan' END AS trigger, ts AS at FROM {events}"
DAYS = "CASE coalesce(interval_override, \"interval\") WHEN 'daily' THEN 1 WHEN 'weekly' THEN 7 WHEN 'biweekly' THEN 14 WHEN 'quarterly' THEN 90 ELSE 30 END"


@query("jn16_auto_complete", f"""WITH tasks AS ({duck(inputs.TASKS)}), triggers AS ({duck(_TRIGGERS)}), last AS (SELECT repo, "trigger" AS kind, max("at") AS done FROM triggers GROUP BY ALL)
SELECT t.repo, task_id, 'completed' AS status, strftime(done, '%Y-%m-%d %H:%M:%S') AS completed, strftime(done + to_days({DAYS}), '%Y-%m-%d %H:%M:%S') AS due
FROM tasks t JOIN last l ON l.repo = t.repo AND l.kind = t."trigger" WHERE status IN ('overdue', 'pending')""")
def auto_complete(spark, sf):
    done = tasks.auto_completed(sql_table(spark, sf, inputs.TASKS), sql_table(spark, sf, _TRIGGERS))
    return done.select("repo", "task_id", "status", stamp("last_completed_at").alias("completed"), stamp("next_due_at").alias("due"))


@query("set01_all_findings")
def all_findings(spark, sf):
    """Rule findings, taint findings and reminders as one table."""
    from ..plans.scan import scan

    return scan(corpus.code(spark, sf), inputs.RULES).select("repo", "path", "line", "code", "severity", "pattern")


def dependency_parts(spark, sf):
    r = sql_table(spark, sf, inputs.REPORTS)
    vulnerable = dependencies.vulnerable_packages(packages_of(spark, sf), advisories_of(spark, sf))
    return reports.audit(r), reports.outdated(r), vulnerable


DEPENDENCY_PARTS = f"{VULNERABLE}, {REPORTS_SQL}, {OUTDATED}, {AUDIT}"


@query("set02_dependency_findings", f"""WITH {DEPENDENCY_PARTS}
SELECT repo, 'package.json' AS path, 0 AS line, 'DEP-AUDIT' AS code, CASE WHEN severity IN ('critical', 'high') THEN 2 WHEN severity = 'moderate' THEN 1 ELSE 0 END AS severity,
  'Vulnerability in ' || name || ': ' || title || ' (' || severity || ')' AS message, CASE WHEN fix_available THEN 'A fix is available: update ' || name || '.' ELSE 'No automatic fix.' END || CASE WHEN url <> '' THEN ' Details: ' || url ELSE '' END AS suggestion, name AS pattern FROM audit
UNION ALL SELECT repo, 'package.json', 0, 'DEP-OUTDATED', CASE WHEN update_type = 'major' THEN 1 ELSE 0 END, name || ' is outdated: ' || current || ' -> ' || latest || ' (' || update_type || ' update)', 'Update ' || name || ' to ' || latest, name FROM outdated
UNION ALL SELECT repo, manifest, 0, 'DEP-OSV', CASE WHEN severity IN ('critical', 'high') THEN 2 WHEN severity IN ('moderate', 'unknown') THEN 1 ELSE 0 END, id || ': ' || name || '@' || version || ' - ' || summary || ' (' || severity || ')',
  'Update ' || name || ' to ' || fixed_version || ' or later. Details: ' || url, name FROM vulnerable""")
def dependency_findings(spark, sf):
    return dependencies.dependency_findings(*dependency_parts(spark, sf)).select(
        "repo", "path", "line", "code", "severity", "message", "suggestion", "pattern"
    )


_REFS = """SELECT source AS repo, lang AS dir, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'Cargo.toml' WHEN 1 THEN 'Cargo.lock' ELSE 'composer.lock' END AS file,
  CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN '[dependencies]' || chr(10) || 'a' || (n_chars % 5) || ' = "1.0.' || (doc_id % 2) || '"'
    WHEN 1 THEN '[[package]]' || chr(10) || 'name = "a' || (n_chars % 5) || '"' || chr(10) || 'version = "1.0.' || (doc_id % 2) || '"' ELSE '{"packages": [{"name": "p", "version": "v1"}]}' END AS content FROM {documents}"""


@query("set03_distinct_packages", f"""WITH m AS ({duck(_REFS)}), kept AS (SELECT * FROM m WHERE file <> 'Cargo.toml' OR NOT EXISTS (SELECT 1 FROM m o WHERE o.repo = m.repo AND o.dir = m.dir AND o.file = 'Cargo.lock')),
  refs AS (SELECT repo, dir, file AS manifest, CASE WHEN file = 'composer.lock' THEN 'Packagist' ELSE 'crates.io' END AS ecosystem,
    CASE file WHEN 'composer.lock' THEN 'p' WHEN 'Cargo.lock' THEN regexp_extract(content, 'name = "([^"]+)"', 1) ELSE regexp_extract(content, '(a[0-9]) =', 1) END AS name,
    CASE file WHEN 'composer.lock' THEN '1' ELSE regexp_extract(content, '"(1[^"]+)"', 1) END AS version FROM kept)
SELECT repo, dir, ecosystem, name, version, arg_min(manifest, {_RANK}) AS manifest FROM refs GROUP BY ALL""")
def distinct_packages(spark, sf):
    return manifests.packages(sql_table(spark, sf, _REFS))


@query("set04_distinct_advisories", """SELECT source AS repo, 'ADV' || (n_chars % 7) AS code, min(lang || '/' || doc_id) AS triggered_by FROM documents GROUP BY ALL""")
def distinct_advisories(spark, sf):
    """Advisories from many files, each code once per repository."""
    rows = corpus.table(spark, sf, "documents").select(
        F.col("source").alias("repo"), F.concat(F.lit("ADV"), (F.col("n_chars") % 7).cast("string")).alias("code"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
    )
    return rows.groupBy("repo", "code").agg(F.min("path").alias("triggered_by"))


@query("set05_persisting_findings", f"WITH {inputs.NEW_FINDINGS_ALL} SELECT {_KEY} FROM new_findings INTERSECT SELECT {_KEY} FROM findings")
def persisting(spark, sf):
    return lifecycle.persisting(inputs.findings(spark, sf), inputs.new_findings(spark, sf))
