"""Queries over counts, scores, learning, windows, insights and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dependencies, fixes, history, insights, learning, lifecycle, statistics, suppression, tasks
from ..operators.learning_store import LearningStore, bucket_stats_of, language_stats_of, merged
from ..plans.workspace import shared_folder
from ..sources.files import EDITOR_LANGUAGES
from . import corpus, inputs
from .corpus import duck, lit, sql_table
from .filters import LEAKS, _LABEL, _SEV
from .joins import DAYS, DEPENDENCY_PARTS, dependency_parts, stamp
from .registry import ORACLES, query
from .sources import SKIPPED

ACTIONS = f"actions AS MATERIALIZED ({duck(inputs.ACTIONS)})"
SCANS = f"scans AS ({duck(inputs.SCANS)})"
FIX_LOG = f"fix_log AS ({duck(inputs.FIX_LOG)})"
TASKS = f"tasks AS ({duck(inputs.TASKS)})"
_BUCKET = """CASE WHEN regexp_matches(lower(path), 'test|spec|__tests__|__mocks__') THEN 'test' WHEN regexp_matches(lower(path), '/config/|\\.config\\.|rc\\.') THEN 'config'
  WHEN regexp_matches(lower(path), '/scripts?/|/tools?/|/utils?/|/helpers?/') THEN 'utility' WHEN regexp_matches(lower(path), '/src/|/lib/|/app/|/components?/') THEN 'source'
  WHEN regexp_matches(lower(path), '/api/|/routes?/|/controllers?/') THEN 'api' ELSE 'other' END"""
_N = lambda a: f"count(*) FILTER (action = '{a}')"
STATS = f"""stats AS (SELECT code, {_N('detected')} AS detections, {_N('false_positive')} AS fps, {_N('fixed')} AS fixed, {_N('ignored')} AS ignored, {_N('verified')} AS verified, {_N('fix_failed')} AS fix_failed,
    coalesce(sum(epoch_ms(ts) - epoch_ms(detected_at)) FILTER (action IN ('fixed', 'ignored', 'false_positive', 'verified') AND detected_at IS NOT NULL), 0)::BIGINT AS resolution_ms,
    count(*) FILTER (action IN ('fixed', 'ignored', 'false_positive', 'verified') AND detected_at IS NOT NULL) AS resolutions, min(ts) AS first_seen, max(ts) FILTER (action = 'detected') AS last_fired FROM actions GROUP BY code)"""
_RATE = lambda a, b: f"CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END"
_FP = _RATE("fps", "fps + fixed + verified")
_EFF = _RATE("fixed + verified", "detections")
_FIX = _RATE("fixed", "fixed + fix_failed")
_R = lambda e: f"round({e}, 6)"


def actions(spark, sf):
    return sql_table(spark, sf, inputs.ACTIONS)


def r6(name):
    return F.round(name, 6).alias(name)


@query("agg01_summary", f"""WITH {inputs.FINDINGS}, named AS (SELECT repo, path, {_LABEL} AS category, {_SEV} AS severity FROM findings)
SELECT repo, 'category' AS kind, category AS key, count(*) AS n FROM named GROUP BY repo, category UNION ALL SELECT repo, 'severity', severity, count(*) FROM named GROUP BY repo, severity
UNION ALL SELECT repo, 'file', path, count(*) FROM named GROUP BY repo, path UNION ALL SELECT repo, 'total', '', count(*) FROM named GROUP BY repo""")
def summary(spark, sf):
    return statistics.summary(inputs.findings(spark, sf))


@query("agg02_build_baseline", f"WITH {inputs.FINDINGS} SELECT repo, path, code, count(*) AS n FROM findings GROUP BY ALL")
def build_baseline(spark, sf):
    return suppression.build_baseline(inputs.findings(spark, sf))


@query("agg03_fail_gate", f"""WITH {inputs.FINDINGS}, w AS (SELECT repo, max(severity) AS worst FROM findings GROUP BY repo)
SELECT repo, worst, 'error' AS fail_on, CASE WHEN worst >= 2 THEN 1 ELSE 0 END AS exit_code FROM w UNION ALL SELECT repo, worst, 'never', 0 FROM w""")
def fail_gate(spark, sf):
    found = inputs.stored_findings(spark, sf)
    return statistics.fail_gate(found, "error").withColumn("fail_on", F.lit("error")).unionByName(
        statistics.fail_gate(found, "never").withColumn("fail_on", F.lit("never"))
    )


@query("agg04_scan_totals", f"""WITH {inputs.FINDINGS}, {SKIPPED}, k AS (SELECT repo, count(*) AS n FROM skipped WHERE line IS NULL GROUP BY repo), s AS (SELECT repo, count(*) AS files_scanned FROM files GROUP BY repo)
SELECT s.repo, files_scanned, coalesce(k.n, 0) AS files_skipped, (SELECT count(*) FROM findings f WHERE f.repo = s.repo) AS total_findings FROM s LEFT JOIN k ON k.repo = s.repo""")
def scan_totals(spark, sf):
    return statistics.scan_totals(corpus.code(spark, sf), inputs.findings(spark, sf))


_SCORES = f"""{inputs.FINDINGS}, {inputs.STATUS_SQL}, open AS (SELECT f.* FROM findings f LEFT JOIN statuses s USING (repo, path, code, line, pattern) WHERE coalesce(s.status, 'pending') NOT IN ('fixed', 'verified', 'ignored')),
  w AS (SELECT repo, count(*) AS open, sum(CASE severity WHEN 2 THEN 3 WHEN 1 THEN 1.5 ELSE 0.5 END)::DOUBLE AS penalty FROM open GROUP BY repo), n AS (SELECT repo, count(DISTINCT path) AS files FROM files GROUP BY repo),
  scores AS (SELECT n.repo, files, coalesce(open, 0) AS open, coalesce(penalty, 0.0) AS penalty, greatest(0, floor(100 - coalesce(penalty, 0.0) / files * 5 + 0.5))::INT AS score FROM n LEFT JOIN w USING (repo))"""


_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade"


@query("agg05_security_score", f"WITH {_SCORES} SELECT *, {_GRADE} FROM scores")
def score(spark, sf):
    found = inputs.stored_findings(spark, sf)
    return statistics.security_score(corpus.code(spark, sf), found, inputs.statuses(spark, sf, found))


@query("agg06_grade", f"WITH {_SCORES} SELECT repo, score, {_GRADE} FROM scores")
def grade(spark, sf):
    found = inputs.stored_findings(spark, sf)
    return statistics.security_score(corpus.code(spark, sf), found, inputs.statuses(spark, sf, found)).select("repo", "score", "grade")


@query("agg07_status_summary", f"""WITH {inputs.FINDINGS}, {inputs.STATUS_SQL} SELECT repo, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'fixed') AS fixed,
  count(*) FILTER (status = 'ignored') AS ignored, count(*) FILTER (status = 'fix-failed') AS fix_failed, count(*) FILTER (status = 'verified') AS verified FROM statuses GROUP BY repo""")
def status_summary(spark, sf):
    return lifecycle.status_summary(inputs.statuses(spark, sf))


_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("agg08_rule_stats", f"WITH {ACTIONS}, {STATS} SELECT code, detections, fps, fixed, ignored, verified, fix_failed, resolution_ms, resolutions, {_TS.format('first_seen')} AS first_seen, {_TS.format('last_fired')} AS last_fired FROM stats")
def rule_stats(spark, sf):
    s = learning.rule_stats(actions(spark, sf))
    return s.select("code", "detections", "fps", "fixed", "ignored", "verified", "fix_failed", "resolution_ms", "resolutions",
                    stamp("first_seen_at").alias("first_seen"), stamp("last_fired_at").alias("last_fired"))


_LANGS = f"langs AS (SELECT code, language, {_N('detected')} AS lang_detections, {_N('false_positive')} AS lang_fps, count(*) FILTER (action IN ('fixed', 'verified')) AS lang_fixed FROM actions GROUP BY ALL)"
_BUCKETS = f"buckets AS (SELECT code, {_BUCKET} AS bucket, {_N('detected')} AS bucket_detections, {_N('false_positive')} AS bucket_fps FROM actions GROUP BY ALL)"


def _kept_sums(spark, sf):
    """The log in batches out of order: odd days, some of them wrong, then even days, a correction of the wrong ones, a repeated batch."""
    store, log = LearningStore(spark, shared_folder(spark)), actions(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    odd = F.dayofmonth("ts") % 2 == 1
    wrong = F.when(F.dayofmonth("ts") == 3, "ignored").otherwise(F.col("action"))
    store.add(1, log.where(odd).withColumn("action", wrong))
    store.add(2, log.where(~odd))
    store.compact()
    store.add(3, log.where(F.dayofmonth("ts") == 3), corrects=True)
    store.add(3, log)
    return store.sums()


@query("agg08_rule_stats_by_batches", ORACLES["agg08_rule_stats"])
def rule_stats_by_batches(spark, sf):
    s = merged(_kept_sums(spark, sf), ["code"])
    return s.select("code", "detections", "fps", "fixed", "ignored", "verified", "fix_failed", "resolution_ms", "resolutions",
                    stamp("first_seen_at").alias("first_seen"), stamp("last_fired_at").alias("last_fired"))


@query("agg09_language_stats", f"WITH {ACTIONS}, {_LANGS} SELECT * FROM langs")
def language_stats(spark, sf):
    return learning.language_stats(actions(spark, sf))


@query("agg09_bucket_stats", f"WITH {ACTIONS}, {_BUCKETS} SELECT * FROM buckets")
def bucket_stats(spark, sf):
    return learning.bucket_stats(actions(spark, sf))


@query("agg09_language_stats_by_batches", ORACLES["agg09_language_stats"])
def language_stats_by_batches(spark, sf):
    return language_stats_of(_kept_sums(spark, sf))


@query("agg09_bucket_stats_by_batches", ORACLES["agg09_bucket_stats"])
def bucket_stats_by_batches(spark, sf):
    return bucket_stats_of(_kept_sums(spark, sf))


@query("agg10_rule_rates", f"WITH {ACTIONS}, {STATS} SELECT code, {_R(_FP)} AS fp_rate, {_R(_EFF)} AS effectiveness, {_R(_FIX)} AS fix_success, {_R(_RATE('resolution_ms', 'resolutions'))} AS mean_resolution_ms FROM stats")
def rule_rates(spark, sf):
    rates = learning.rule_rates(learning.rule_stats(actions(spark, sf)))
    return rates.select("code", r6("fp_rate"), r6("effectiveness"), r6("fix_success"), r6("mean_resolution_ms"))


@query("agg11_likely_real", f"""WITH {ACTIONS}, {STATS}, {_LANGS}, {_BUCKETS}, places AS (SELECT DISTINCT code, language, path, {_BUCKET} AS bucket FROM actions),
  j AS (SELECT p.*, detections, 1 - {_FP} AS base, lang_fps, lang_fixed, bucket_fps, bucket_detections FROM places p LEFT JOIN stats USING (code) LEFT JOIN langs USING (code, language) LEFT JOIN buckets USING (code, bucket)),
  l AS (SELECT *, CASE WHEN lang_fps + lang_fixed >= 3 THEN base * 0.6 + (1 - lang_fps::DOUBLE / (lang_fps + lang_fixed)) * 0.4 ELSE base END AS s1 FROM j),
  b AS (SELECT *, CASE WHEN bucket_fps + bucket_detections >= 3 AND bucket_detections > 0 THEN s1 * 0.8 + (1 - bucket_fps::DOUBLE / bucket_detections) * 0.2 ELSE s1 END AS s2 FROM l)
SELECT code, language, path, {_R('CASE WHEN coalesce(detections, 0) < 5 THEN 0.5 ELSE greatest(0.0, least(1.0, s2)) END')} AS likely_real FROM b""")
def likely_real(spark, sf):
    log = actions(spark, sf)
    places = log.select("code", "language", "path").distinct()
    return learning.likely_real(places, log).withColumn("likely_real", F.round("likely_real", 6))


_ACTED = "fps + fixed + verified + ignored"
_INSIGHTS = f"""rule_insights AS (SELECT code, 'high_fp_rate' AS type, {_FP} AS value FROM stats WHERE {_ACTED} >= 5 AND {_FP} >= 0.7
  UNION ALL SELECT code, 'highly_effective', {_EFF} FROM stats WHERE detections >= 5 AND {_EFF} >= 0.6
  UNION ALL SELECT code, 'never_acted_on', detections::DOUBLE FROM stats WHERE detections >= 10 AND {_ACTED} = 0
  UNION ALL SELECT code, 'ai_fix_struggles', fix_failed::DOUBLE / (fixed + fix_failed) FROM stats WHERE fixed + fix_failed >= 3 AND fix_failed::DOUBLE / (fixed + fix_failed) >= 0.5)"""


@query("agg12_rule_insights", f"WITH {ACTIONS}, {STATS}, {_INSIGHTS} SELECT code, type, {_R('value')} AS value FROM rule_insights")
def rule_insights(spark, sf):
    return learning.rule_insights(learning.rule_stats(actions(spark, sf))).select("code", "type", r6("value"))


_CHAMPIONS = """families AS (SELECT regexp_replace(code, '\\d+$', '') AS family, sum(detections)::BIGINT AS total, sum(fixed + verified)::BIGINT AS resolved FROM stats GROUP BY 1)"""


@query("agg13_category_champions", f"WITH {ACTIONS}, {STATS}, {_CHAMPIONS} SELECT * FROM families WHERE total >= 5 AND resolved >= total * 0.9")
def champions(spark, sf):
    return learning.category_champions(learning.rule_stats(actions(spark, sf)))


@query("agg14_fix_success", f"""WITH {ACTIONS}, {STATS}, t AS (SELECT sum(fixed + fix_failed)::BIGINT AS attempts, sum(fixed)::BIGINT AS succeeded FROM stats), r AS (SELECT *, floor(succeeded / attempts::DOUBLE * 100 + 0.5)::INT AS rate FROM t)
SELECT attempts, succeeded, rate, CASE WHEN rate >= 80 THEN 'celebration' ELSE 'info' END AS severity FROM r WHERE attempts >= 5""")
def fix_success(spark, sf):
    return learning.overall_fix_success(learning.rule_stats(actions(spark, sf)))


_ZONES = f"""zones AS (SELECT {_BUCKET} AS zone, {_N('detected')} AS total, {_N('false_positive')} AS fps FROM actions GROUP BY 1 HAVING count(*) FILTER (action = 'detected') >= 5),
  hot AS (SELECT zone, greatest(0, total - fps) AS confirmed, total, fps::DOUBLE / total AS fp_rate, greatest(0, total - fps)::DOUBLE / total AS risk FROM zones)"""


@query("agg15_hot_zones", f"WITH {ACTIONS}, {_ZONES} SELECT zone, confirmed, total, {_R('fp_rate')} AS fp_rate, {_R('risk')} AS risk FROM hot")
def hot_zones(spark, sf):
    return learning.hot_zones(actions(spark, sf)).select("zone", "confirmed", "total", r6("fp_rate"), r6("risk"))


# Shapes of the log's two kinds of lines, worked out by hand.
_SHAPES = """shaped AS (SELECT repo, ts, code, language, outcome, 'const $VAR1 = $VAR2 * $NUM + $STRING;' AS norm_before,
    CASE WHEN starts_with(after, 'const total') THEN 'const $VAR1 = $VAR2 * $NUM + $STRING;' WHEN starts_with(after, 'const safe') THEN 'const $VAR1 = sanitize($VAR2, $NUM, $STRING);' ELSE 'let $VAR1 = $VAR2($VAR3);' END AS norm_after FROM fix_log),
  patterns AS (SELECT repo, code, language, norm_before, norm_after, count(*) FILTER (outcome = 'applied') AS applied, count(*) FILTER (outcome = 'succeeded') AS succeeded, count(*) FILTER (outcome = 'failed') AS failed, max(ts) AS last_used_at
    FROM shaped WHERE norm_before <> norm_after GROUP BY ALL)"""


def fix_patterns(spark, sf):
    return fixes.learned_fixes(inputs.fix_log(spark, sf))


@query("agg16_fix_pattern_stats", f"""WITH {FIX_LOG}, {_SHAPES} SELECT count(*) AS total, count(*) FILTER (succeeded > 0) AS with_successes, sum(applied)::BIGINT AS total_reuses,
  {_R('coalesce(avg(succeeded::DOUBLE / applied) FILTER (applied > 0), 0)')} AS avg_success_rate FROM patterns""")
def fix_pattern_stats(spark, sf):
    return fixes.fix_pattern_stats(fix_patterns(spark, sf)).withColumn("avg_success_rate", F.round("avg_success_rate", 6))


_HELPERS = f"""seen AS (SELECT repo, code, ts, CASE action WHEN 'fixed' THEN 'ai_fix' ELSE 'user_fp' END AS source, unnest(list_concat(
    list_filter([{', '.join(lit(h) for h in learning.KNOWN_HELPERS)}], lambda h: contains(line_text, h)),
    CASE WHEN action = 'fixed' THEN []::VARCHAR[] ELSE list_filter(regexp_extract_all(line_text, '([a-zA-Z_$][\\w$.]*)\\s*\\(', 1), lambda c: c NOT IN ('if', 'for', 'while', 'switch', 'function', 'return', 'require', 'import', 'console') AND regexp_matches(c, '(?i)sanitiz|valid|escap|encod|purg|clean|filter|strip')) END)) AS function
  FROM actions WHERE action IN ('fixed', 'false_positive') AND line_text IS NOT NULL),
  helpers AS (SELECT repo, function, array_to_string(list_sort(list_distinct(list(code))), ',') AS codes, count(*) AS observed,
    round(least(1.0, CASE WHEN arg_min(source, (ts, source)) = 'ai_fix' THEN 0.7 ELSE 0.5 END + 0.1 * (count(*) - 1)), 6)::DOUBLE AS confidence, CASE WHEN bool_or(source = 'ai_fix') THEN 'ai_fix' ELSE 'user_fp' END AS source FROM seen GROUP BY repo, function)"""


@query("agg17_safe_helpers", f"WITH {ACTIONS}, {_HELPERS} SELECT * FROM helpers")
def safe_helpers(spark, sf):
    return learning.safe_helpers(actions(spark, sf)).withColumn("codes", F.array_join("codes", ",")).withColumn("confidence", F.round("confidence", 6))


@query("agg18_usage_rollup", f"WITH {ACTIONS}, {STATS} SELECT code, detections, fps, fixed, ignored, verified, fix_failed, {_R(_FIX)} AS fix_success, (SELECT string_agg(DISTINCT language, ',' ORDER BY language) FROM actions a WHERE a.code = s.code) AS languages FROM stats s")
def usage_rollup(spark, sf):
    return learning.usage_rollup(actions(spark, sf)).withColumn("fix_success", F.round("fix_success", 6))


_EXT_LANG = "CASE " + " ".join(f"WHEN ext IN ({', '.join(lit(e) for e in es)}) THEN '{l}'" for l, es in EDITOR_LANGUAGES.items()) + " END"


@query("agg19_scan_estimate", f"""WITH places AS ({duck(inputs.PLACES)}), e AS (SELECT lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1)) AS ext FROM places), l AS (SELECT {_EXT_LANG} AS language FROM e)
SELECT language, count(*) AS files, ceil(count(*) / 50.0)::BIGINT AS batches FROM l WHERE language IS NOT NULL GROUP BY language""")
def scan_estimate(spark, sf):
    return statistics.scan_estimate(sql_table(spark, sf, inputs.PLACES))


@query("agg20_dependency_summary", f"""WITH {DEPENDENCY_PARTS} SELECT repo, 'audit' AS kind, severity AS key, count(*) AS n FROM audit GROUP BY ALL
UNION ALL SELECT repo, 'outdated', update_type, count(*) FROM outdated GROUP BY ALL UNION ALL SELECT repo, 'advisory', manifest, count(*) FROM vulnerable GROUP BY ALL""")
def dependency_summary(spark, sf):
    return dependencies.dependency_summary(*dependency_parts(spark, sf))


@query("agg21_task_summary", f"""WITH {TASKS} SELECT repo, count(*) AS total, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in tasks.STATUS_ORDER)},
  count(*) FILTER (status IN ('pending', 'completed') AND next_due_at <= {inputs.NOW} + INTERVAL 24 HOUR) AS due_soon FROM tasks GROUP BY repo""")
def task_summary(spark, sf):
    return tasks.task_summary(sql_table(spark, sf, inputs.TASKS), F.expr(inputs.NOW))


@query("agg22_history_by_commit", f"WITH {LEAKS} SELECT repo, sha, author, committed_at, count(*) AS n, string_agg(DISTINCT code, ',' ORDER BY code) AS rules, count(DISTINCT path) AS files FROM leaks GROUP BY ALL")
def history_by_commit(spark, sf):
    return history.history_by_commit(history.history_findings(sql_table(spark, sf, inputs.PATCHES)))


def scan_versions(spark, sf):
    first, second = inputs.stored_findings(spark, sf), inputs.stored_new_findings(spark, sf)
    third = first.where(F.col("severity") > 0)
    return first.withColumn("seq", F.lit(1)).unionByName(second.withColumn("seq", F.lit(2))).unionByName(third.withColumn("seq", F.lit(3)))


_VERSIONS = """versions AS (SELECT repo, 1 AS seq, path, code, line, pattern, severity FROM findings UNION ALL SELECT repo, 2, path, code, line, pattern, severity FROM new_findings UNION ALL SELECT repo, 3, path, code, line, pattern, severity FROM findings WHERE severity > 0)"""
_POSTURE = f"""{_VERSIONS}, totals AS (SELECT repo, seq, count(*) AS total, count(*) FILTER (severity = 2) AS critical FROM versions GROUP BY ALL),
  posture AS (SELECT repo, seq, total, critical,
    CASE WHEN seq = 1 THEN 0 ELSE (SELECT count(*) FROM versions v WHERE v.repo = t.repo AND v.seq = t.seq - 1 AND NOT EXISTS (SELECT 1 FROM versions w WHERE w.seq = v.seq + 1 AND w.repo = v.repo AND w.path = v.path AND w.code = v.code AND w.line = v.line AND w.pattern = v.pattern)) END AS resolved_since_last,
    CASE WHEN seq = 1 THEN 0 ELSE (SELECT count(*) FROM versions v WHERE v.repo = t.repo AND v.seq = t.seq AND NOT EXISTS (SELECT 1 FROM versions w WHERE w.seq = v.seq - 1 AND w.repo = v.repo AND w.path = v.path AND w.code = v.code AND w.line = v.line AND w.pattern = v.pattern)) END AS new_since_last FROM totals t)"""


@query("agg23_posture", f"WITH {inputs.NEW_FINDINGS_ALL}, {_POSTURE} SELECT * FROM posture")
def posture(spark, sf):
    return lifecycle.posture(scan_versions(spark, sf))


@query("win01_reminders", f"WITH {inputs.FINDINGS} SELECT repo, path, line, code FROM findings WHERE code LIKE 'BIZ%' OR code LIKE 'HDR%'")
def reminders(spark, sf):
    """Reminder rules fire once per file, at the most telling of their first ten lines."""
    found = inputs.findings(spark, sf)
    return found.where(F.col("code").startswith("BIZ") | F.col("code").startswith("HDR")).select("repo", "path", "line", "code")


from .oracle import _SCORE  # noqa: E402
from ..operators.matching import reminder_score  # noqa: E402
from ..sources.files import lines  # noqa: E402


@query("win02_line_scores", f"WITH {corpus.CODE},{corpus.lines_sql()} SELECT repo, path, line, {_SCORE} AS score FROM lines")
def line_scores(spark, sf):
    return lines(corpus.code(spark, sf)).select("repo", "path", "line", reminder_score(F.col("text")).alias("score"))


@query("win03_baseline_budget", f"""WITH {inputs.FINDINGS}, b AS (SELECT repo, path, code, 1 AS n FROM findings GROUP BY ALL), r AS (SELECT f.*, row_number() OVER (PARTITION BY f.repo, f.path, f.code ORDER BY line, col, pattern) <= n AS baselined FROM findings f JOIN b USING (repo, path, code))
SELECT repo, code, count(*) FILTER (baselined) AS baselined, count(*) FILTER (NOT baselined) AS new_findings FROM r GROUP BY ALL""")
def baseline_budget(spark, sf):
    found = inputs.stored_findings(spark, sf)
    baseline = suppression.build_baseline(found).withColumn("n", F.lit(1))
    split = suppression.apply_baseline(found, baseline)
    return split.groupBy("repo", "code").agg(F.count_if("baselined").alias("baselined"), F.count_if(~F.col("baselined")).alias("new_findings"))


@query("win04_rule_index", f"WITH {inputs.FINDINGS}, f AS (SELECT repo, code, min((path, line, code)) AS p FROM findings GROUP BY ALL) SELECT repo, code, (row_number() OVER (PARTITION BY repo ORDER BY p) - 1)::INT AS rule_index FROM f")
def rule_index(spark, sf):
    from ..operators.export import rule_index

    return rule_index(inputs.findings(spark, sf))


_TREND = """ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, scan_id DESC) AS n FROM scans),
  means AS (SELECT repo, avg(total_issues) FILTER (n <= 3) AS recent_avg, avg(total_issues) FILTER (n BETWEEN 4 AND 6) AS previous_avg FROM ranked WHERE n <= 6 GROUP BY repo HAVING count(*) = 6),
  trends AS (SELECT *, (recent_avg - previous_avg) / previous_avg * 100 AS change FROM means WHERE previous_avg <> 0),
  trend AS (SELECT *, CASE WHEN change <= -10 THEN 'improving' WHEN change >= 15 THEN 'degrading' ELSE 'steady' END AS direction FROM trends)"""


def scans(spark, sf):
    return sql_table(spark, sf, inputs.SCANS)


@query("win05_trend", f"WITH {SCANS}, {_TREND} SELECT repo, {_R('recent_avg')} AS recent_avg, {_R('previous_avg')} AS previous_avg, {_R('change')} AS change, direction FROM trend")
def trend(spark, sf):
    return insights.trend(scans(spark, sf)).select("repo", r6("recent_avg"), r6("previous_avg"), r6("change"), "direction")


_BEST = "best AS (SELECT * FROM patterns WHERE succeeded > 0 QUALIFY row_number() OVER (PARTITION BY repo, code, language, norm_before ORDER BY CASE WHEN applied > 0 THEN succeeded::DOUBLE / applied ELSE 0 END DESC, applied DESC, norm_after) = 1)"


@query("win06_best_fixes", f"WITH {FIX_LOG}, {_SHAPES}, {_BEST} SELECT repo, code, language, norm_before, norm_after, applied, succeeded FROM best")
def best_fixes(spark, sf):
    return fixes.best_fixes(fix_patterns(spark, sf)).select("repo", "code", "language", "norm_before", "norm_after", "applied", "succeeded")


@query("win07_retention", f"WITH {SCANS} SELECT repo, scan_id, total_issues FROM scans QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ts DESC, scan_id) <= 5")
def retention(spark, sf):
    return lifecycle.last_per_repo(scans(spark, sf), [F.col("ts").desc(), F.col("scan_id")], 5).select("repo", "scan_id", "total_issues")


@query("win07_retained_fixes", f"WITH {FIX_LOG}, {_SHAPES} SELECT repo, code, language, norm_after FROM patterns QUALIFY row_number() OVER (PARTITION BY repo ORDER BY succeeded - failed DESC, last_used_at DESC, code, norm_before, norm_after) <= 10")
def retained_fixes(spark, sf):
    return fixes.retained_fixes(fix_patterns(spark, sf), 10).select("repo", "code", "language", "norm_after")


_REGRESSED = f"""{inputs.NEW_FINDINGS_ALL}, {inputs.STATUS_SQL}, regressions AS (SELECT DISTINCT f.repo, f.path, f.code, f.line, f.code = 'AUTH004' AS acknowledged FROM new_findings f JOIN statuses s ON s.status = 'verified' AND s.repo = f.repo AND s.path = f.path AND s.code = f.code)"""


def regressed(spark, sf):
    old = inputs.findings(spark, sf)  # not stored: only the statuses read it
    none = old.where(F.lit(False)).select("repo", "path", "code", "line")
    found = lifecycle.regressions(inputs.new_findings(spark, sf), inputs.statuses(spark, sf, old), none)
    return found.withColumn("acknowledged", F.col("code") == "AUTH004")


_REG_SUM = """per_file AS (SELECT repo, path, count(*) AS n FROM regressions WHERE NOT acknowledged GROUP BY ALL),
  regression_summary AS (SELECT repo, sum(n)::BIGINT AS regressions, count(*) AS files, array_to_string(list_sort(list(path))[1:3], ', ') AS sample FROM per_file GROUP BY repo)"""


@query("win08_regression_summary", f"WITH {_REGRESSED}, {_REG_SUM} SELECT * FROM regression_summary")
def regression_summary(spark, sf):
    return insights.regression_summary(regressed(spark, sf))


@query("win09_top_hot_zone", f"WITH {ACTIONS}, {_ZONES}, top AS (SELECT * FROM hot ORDER BY risk DESC, zone DESC LIMIT 1) SELECT zone, confirmed, total, {_R('risk')} AS risk FROM top WHERE risk >= 0.5 AND confirmed >= 5")
def top_hot_zone(spark, sf):
    return insights.top_hot_zone(learning.hot_zones(actions(spark, sf))).withColumn("risk", F.round("risk", 6))


@query("win10_insights", f"""WITH {ACTIONS}, {STATS}, {_INSIGHTS}, {_CHAMPIONS}, {SCANS}, {_TREND}, {_ZONES}, {FIX_LOG}, {_SHAPES}, returned AS (WITH {_REGRESSED}, {_REG_SUM} SELECT * FROM regression_summary), said AS (
  SELECT 'trend_' || direction AS type, CASE direction WHEN 'improving' THEN 'celebration' ELSE 'warning' END AS severity, repo || CASE direction WHEN 'improving' THEN ': posture improves' ELSE ': findings increase' END AS title FROM trend WHERE direction <> 'steady'
  UNION ALL SELECT CASE type WHEN 'high_fp_rate' THEN 'rule_noisy' WHEN 'highly_effective' THEN 'rule_effective' WHEN 'never_acted_on' THEN 'stale_issues' ELSE 'ai_fix_effective' END,
    CASE WHEN type IN ('high_fp_rate', 'never_acted_on') THEN 'suggestion' ELSE 'info' END, code || CASE type WHEN 'high_fp_rate' THEN ' is often dismissed' WHEN 'highly_effective' THEN ' is usually acted on' WHEN 'never_acted_on' THEN ' is never acted on' ELSE ' resists automatic fixes' END FROM rule_insights
  UNION ALL SELECT 'category_champion', 'celebration', family || ' is nearly resolved' FROM families WHERE total >= 5 AND resolved >= total * 0.9
  UNION ALL SELECT 'hot_zone', 'suggestion', 'Hot zone: ' || zone FROM (SELECT * FROM hot ORDER BY risk DESC, zone DESC LIMIT 1) WHERE risk >= 0.5 AND confirmed >= 5
  UNION ALL SELECT 'fix_pattern_available', 'info', n || ' fix patterns learned' FROM (SELECT count(*) AS n FROM patterns) WHERE n >= 5
  UNION ALL SELECT 'ai_fix_effective', CASE WHEN rate >= 80 THEN 'celebration' ELSE 'info' END, 'Automatic fixes succeed in ' || rate || '%' FROM (SELECT floor(sum(fixed) / sum(fixed + fix_failed)::DOUBLE * 100 + 0.5)::INT AS rate, sum(fixed + fix_failed) AS attempts FROM stats) WHERE attempts >= 5
  UNION ALL SELECT 'regression_detected', 'warning', repo || ': ' || regressions || ' findings came back' FROM returned)
SELECT type, severity, title, CASE severity WHEN 'warning' THEN 0 WHEN 'suggestion' THEN 1 WHEN 'celebration' THEN 2 ELSE 3 END AS place FROM said""")
def all_insights(spark, sf):
    log = actions(spark, sf)
    stats = learning.rule_stats(log)
    merged = insights.all_insights(
        insights.trend_insights(scans(spark, sf)), insights.rule_statements(learning.rule_insights(stats)),
        insights.champion_statements(learning.category_champions(stats)), insights.hot_zone_statements(learning.hot_zones(log)),
        insights.fix_statements(fixes.fix_pattern_stats(fix_patterns(spark, sf)), learning.overall_fix_success(stats)),
        insights.regression_statements(regressed(spark, sf)),
    )
    return merged.select("type", "severity", "title", insights.severity_order(F.col("severity")).alias("place"))


@query("win11_triage_queue", f"""WITH {inputs.FINDINGS}, {inputs.STATUS_SQL} SELECT f.repo, f.path, f.line, f.code, f.severity FROM findings f LEFT JOIN statuses s USING (repo, path, code, line, pattern) WHERE coalesce(s.status, 'pending') = 'pending'""")
def triage(spark, sf):
    found = inputs.stored_findings(spark, sf)
    return lifecycle.triage_queue(found, inputs.statuses(spark, sf, found)).select("repo", "path", "line", "code", "severity")


@query("win12_first_findings", f"""WITH {inputs.FINDINGS}, n AS (SELECT count(*) AS total_findings FROM findings WHERE severity >= 1)
SELECT repo, path, line, code, total_findings, total_findings > 200 AS truncated FROM findings, n WHERE severity >= 1 ORDER BY repo, path, line, code, col LIMIT 200""")
def first_findings(spark, sf):
    return statistics.first_findings(inputs.stored_findings(spark, sf), 200, "warning").select("repo", "path", "line", "code", "total_findings", "truncated")


@query("win13_by_advisory_severity", f"WITH {DEPENDENCY_PARTS} SELECT repo, dir, name, version, id, severity, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'moderate' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS place FROM vulnerable")
def by_advisory_severity(spark, sf):
    from ..functions.versions import severity_rank

    _, _, vulnerable = dependency_parts(spark, sf)
    return dependencies.by_severity(vulnerable).select("repo", "dir", "name", "version", "id", "severity", severity_rank(F.col("severity")).alias("place"))


@query("win14_task_board", f"WITH {TASKS} SELECT repo, task_id, status, priority, CASE status WHEN 'overdue' THEN 1 WHEN 'pending' THEN 2 WHEN 'completed' THEN 3 WHEN 'snoozed' THEN 4 ELSE 5 END AS group_rank FROM tasks")
def task_board(spark, sf):
    return tasks.task_board(sql_table(spark, sf, inputs.TASKS)).select("repo", "task_id", "status", "priority", "group_rank")


@query("win15_latest_scan", f"WITH {SCANS} SELECT repo, arg_max(scan_id, ts) AS scan_id, arg_max(total_issues, ts) AS total_issues FROM scans GROUP BY repo")
def latest_scan(spark, sf):
    return lifecycle.last_per_repo(scans(spark, sf), [F.col("ts").desc()], 1).select("repo", "scan_id", "total_issues")


@query("win16_learning_table", f"WITH {ACTIONS}, {STATS} SELECT code, detections, {_R(_FP)} AS fp_rate, {_R(_EFF)} AS effectiveness, {_R(_FIX)} AS fix_success, fixed, ignored, fps, verified, fix_failed FROM stats")
def learning_table(spark, sf):
    t = learning.learning_table(actions(spark, sf))
    return t.select("code", "detections", r6("fp_rate"), r6("effectiveness"), r6("fix_success"), "fixed", "ignored", "fps", "verified", "fix_failed")


_SWEPT = f"""{TASKS}, woke AS (SELECT *, status = 'snoozed' AND snooze_until IS NOT NULL AND snooze_until <= {inputs.NOW} AS w FROM tasks), s AS (SELECT *, CASE WHEN w THEN 'pending' ELSE status END AS s1 FROM woke)"""


@query("fn18_due_dates", f"""WITH {_SWEPT} SELECT repo, task_id, CASE WHEN s1 IN ('pending', 'completed') AND next_due_at <= {inputs.NOW} THEN 'overdue' ELSE s1 END AS status,
  s1 IN ('pending', 'completed') AND next_due_at <= {inputs.NOW} AS newly_overdue, strftime({inputs.NOW} + to_days({DAYS}), '%Y-%m-%d') AS due_if_completed,
  strftime(coalesce(last_completed_at, {inputs.NOW}) + to_days(14), '%Y-%m-%d') AS due_if_biweekly FROM s""")
def due_dates(spark, sf):
    now = F.expr(inputs.NOW)
    t = sql_table(spark, sf, inputs.TASKS)
    day = lambda d, name: d.select("repo", "task_id", F.date_format("next_due_at", "yyyy-MM-dd").alias(name))
    state = tasks.swept(t, now).select("repo", "task_id", "status", "newly_overdue")
    both = day(tasks.completed(t, now), "due_if_completed").join(day(tasks.rescheduled(t, "biweekly", now), "due_if_biweekly"), ["repo", "task_id"])
    return state.join(both, ["repo", "task_id"])


# The log's lines have known pieces, so the fix put back into a line can be spelled out.
ORACLES["jn12_fix_lookup"] = f"""WITH {FIX_LOG}, {_SHAPES}, {_BEST}, l AS (SELECT DISTINCT repo, code, language, before AS text FROM fix_log),
  p AS (SELECT *, regexp_extract(text, '(total[0-9]+)', 1) AS t, regexp_extract(text, '[*] ([0-9]+)', 1) AS k, regexp_extract(text, '"a([0-9]+)"', 1) AS u FROM l)
SELECT p.repo, p.code, p.language, p.text, CASE WHEN starts_with(norm_after, 'const') THEN '  const ' || t || ' = sanitize(price, ' || k || ', "a' || u || '");' ELSE '  let ' || t || ' = price(a' || u || ');' END AS suggested,
  {_R('CASE WHEN applied > 0 THEN succeeded::DOUBLE / applied ELSE 0 END')} AS success_rate FROM p JOIN best b ON b.repo = p.repo AND b.code = p.code AND b.language = p.language"""
