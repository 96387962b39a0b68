"""Queries over sinks and streams: what is written is read back, what is streamed is run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import documents, export, history, suppression
from ..operators.matching import project_advisories
from ..plans.scan import scan
from ..plans.workspace import shared_folder, written
from ..rules import all_rules
from ..rules.taint import SINKS
from ..sources import policies
from ..sources.files import tasks_wanted
from ..streaming import jobs
from . import corpus, inputs, oracle
from .corpus import duck, lines_sql, sql_table
from .counts import _BUCKETS, ACTIONS, _SWEPT
from .filters import _ADVICE, LEAKS, _LABEL, _SEV
from .joins import VULNERABLE, advisories_of
from .registry import ORACLES, query
from .scalars import TAINT
from .sources import IGNORES

_EXPORT = f"export AS (SELECT repo, path AS file, line + 1 AS line, col + 1 AS \"column\", {_SEV} AS severity, code, {_LABEL} AS category, message, suggestion, pattern FROM findings)"
_ROWS = "repo string, file string, line int, column int, severity string, code string, category string, message string, suggestion string"


@query("snk01_json", f"WITH {inputs.FINDINGS}, {_EXPORT} SELECT * FROM export")
def json_export(spark, sf):
    folder = shared_folder(spark)
    export.write_json(inputs.findings(spark, sf), folder, mask=False)
    return spark.read.schema(_ROWS + ", pattern string").json(folder)


@query("snk01_json_masked", f"WITH {inputs.FINDINGS}, {_EXPORT} SELECT repo, file, line, code, sha256(pattern) AS pattern FROM export")
def json_export_masked(spark, sf):
    folder = shared_folder(spark)
    export.write_json(inputs.findings(spark, sf), folder)
    return spark.read.schema(_ROWS + ", pattern string").json(folder).select("repo", "file", "line", "code", "pattern")


@query("snk01_advisories", f"""WITH {corpus.CODE},{lines_sql()}, hits AS ({oracle.hits(_ADVICE)}), found AS (SELECT DISTINCT repo, code, category FROM hits)
SELECT repo, 'project-advisory' AS type, code, {_LABEL} AS category FROM found r""")
def advisory_export(spark, sf):
    """Project advisories written as JSON and read back."""
    folder = shared_folder(spark)
    export.write_advisories(project_advisories(corpus.code(spark, sf), all_rules()), folder)
    rows = spark.read.schema("value string, repo string").text(folder)
    return rows.select("repo", F.from_json("value", "type string, code string, category string").alias("a")).select("repo", "a.*")


@query("snk02_csv", f"WITH {inputs.FINDINGS}, {_EXPORT} SELECT * EXCLUDE (pattern) FROM export")
def csv_export(spark, sf):
    folder = shared_folder(spark)
    export.write_csv(inputs.findings(spark, sf), folder)
    columns = _ROWS.removeprefix("repo string, ") + ", repo string"
    return spark.read.schema(columns).option("header", "true").csv(folder)


_RESULT = ("struct<ruleId:string,ruleIndex:int,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:"
           "struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>>")


@query("snk03_sarif", f"""WITH {inputs.FINDINGS}, r AS (SELECT repo, path, code, dense_rank() OVER (PARTITION BY repo, path ORDER BY min((line, code))) - 1 AS ix FROM findings GROUP BY repo, path, code)
SELECT f.repo, f.path AS uri, f.code AS rule_id, ix AS rule_index, CASE severity WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'note' END AS level, message || chr(10) || chr(10) || 'Suggestion: ' || suggestion AS text, line + 1 AS start_line, col + 1 AS start_column
FROM findings f JOIN r ON r.repo = f.repo AND r.path = f.path AND r.code = f.code""")
def sarif_export(spark, sf):
    folder = shared_folder(spark)
    export.write_documents(export.sarif_logs(inputs.findings(spark, sf)), "sarif", folder)
    logs = spark.read.schema("value string, repo string").text(folder)
    runs = F.from_json("value", f"runs array<struct<results:array<{_RESULT}>>>")["runs"]
    r = logs.select("repo", F.explode(runs[0]["results"]).alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return r.select("repo", place["artifactLocation"]["uri"].alias("uri"), F.col("r.ruleId").alias("rule_id"), F.col("r.ruleIndex").alias("rule_index"),
                    F.col("r.level").alias("level"), F.col("r.message.text").alias("text"), place["region"]["startLine"].alias("start_line"),
                    place["region"]["startColumn"].alias("start_column"))


@query("snk03_sarif_workspace", f"""WITH {inputs.FINDINGS}, r AS (SELECT repo, code, row_number() OVER (PARTITION BY repo ORDER BY min((path, line, code))) - 1 AS ix FROM findings GROUP BY repo, code)
SELECT f.repo, f.path AS uri, f.code AS rule_id, ix AS rule_index, line + 1 AS start_line, col + 1 AS start_column, (SELECT count(*) FROM r c WHERE c.repo = f.repo) AS rules, count(*) OVER (PARTITION BY f.repo) AS results
FROM findings f JOIN r ON r.repo = f.repo AND r.code = f.code""")
def sarif_workspace(spark, sf):
    """One log for each repository, written as lines and read again: its results, and what its frame says."""
    folder = shared_folder(spark)
    documents.write_framed(documents.sarif_lines(inputs.stored_findings(spark, sf)), folder)
    lines = written(spark.read.schema("value string, repo string").text(folder))
    entry = F.from_json(F.regexp_replace("value", "^,", ""), _RESULT)
    results = lines.where(F.col("value").rlike('^,?[{]"ruleId"')).select("repo", entry.alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    head = F.from_json(F.concat("value", F.lit("]}]}")), "runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>>>")
    heads = lines.where(F.col("value").startswith('{"$schema"')).select("repo", F.size(head["runs"][0]["tool"]["driver"]["rules"]).alias("rules"))
    commas = lines.groupBy("repo").agg(F.count(F.when(F.col("value").startswith(","), 1)).alias("commas"))
    told = results.select("repo", place["artifactLocation"]["uri"].alias("uri"), F.col("r.ruleId").alias("rule_id"), F.col("r.ruleIndex").alias("rule_index"),
                          place["region"]["startLine"].alias("start_line"), place["region"]["startColumn"].alias("start_column"))
    return told.join(heads, "repo").join(commas, "repo").select(*told.columns, "rules", (F.col("commas") + 1).alias("results"))


@query("snk05_baseline_workspace", f"WITH {inputs.FINDINGS} SELECT repo, path, code, count(*) AS n FROM findings GROUP BY ALL")
def baseline_workspace(spark, sf):
    """One baseline for each repository, written as lines; each line is parsed in the frame of a document of its own."""
    folder = shared_folder(spark)
    documents.write_framed(documents.baseline_lines(suppression.build_baseline(inputs.findings(spark, sf))), folder)
    lines = spark.read.schema("value string, repo string").text(folder).where(F.col("value").rlike('^,?"'))
    whole = F.concat(F.lit('{"version":1,"counts":{'), F.regexp_replace("value", "^,", ""), F.lit("}}"))
    return policies.baseline_entries(lines.select("repo", whole.alias("content")))


@query("snk04_text", f"""WITH {inputs.FINDINGS} SELECT repo, path, '--- ' || path || ' (' || count(*) || ' issue(s)) ---' || chr(10)
  || string_agg('  [' || {_SEV} || '] ' || code || ' (Line ' || (line + 1) || '): ' || message || chr(10) || '    Suggestion: ' || suggestion, chr(10) ORDER BY line, code, col) AS report FROM findings GROUP BY repo, path""")
def text_export(spark, sf):
    return export.text_reports(inputs.findings(spark, sf))


@query("snk05_baseline", f"WITH {inputs.FINDINGS} SELECT repo, path, code, count(*) AS n FROM findings GROUP BY ALL")
def baseline_export(spark, sf):
    folder = shared_folder(spark)
    export.write_documents(export.baseline_documents(suppression.build_baseline(inputs.findings(spark, sf))), "json", folder)
    stored = spark.read.schema("value string, repo string").text(folder)
    return policies.baseline_entries(stored.select("repo", F.col("value").alias("content")))


@query("snk06_ignore_entries", f"WITH {IGNORES} SELECT * FROM ignores")
def ignore_export(spark, sf):
    """Entries written as lines and parsed again."""
    entries = policies.ignore_entries(sql_table(spark, sf, inputs.IGNORE_FILES))
    folder = shared_folder(spark)
    line = policies.ignore_line(F.col("code"), F.col("path"), F.col("line"), F.col("reason"))
    export.append_table(entries.select("repo", line.alias("content")), folder)
    return policies.ignore_entries(spark.read.schema("content string, repo string").parquet(folder))


@query("snk07_scan_history", f"""WITH {inputs.FINDINGS}, n AS (SELECT repo, count(*) AS total_files FROM files GROUP BY repo)
SELECT n.repo, 'scan-1' AS scan_id, 'workspace' AS scan_type, 1200 AS duration_ms, total_files, count(f.code) AS total_issues, count(*) FILTER (severity = 2) AS errors, count(*) FILTER (category = 'cors-configuration') AS cors
FROM n LEFT JOIN findings f ON f.repo = n.repo GROUP BY ALL""")
def scan_history(spark, sf):
    folder = shared_folder(spark)
    record = export.scan_record(inputs.findings(spark, sf), corpus.code(spark, sf), F.lit("scan-1"), F.current_timestamp(), "workspace", F.lit(1200))
    export.append_table(record, folder)
    stored = spark.read.schema(record.schema).parquet(folder)
    get = lambda m, k, name: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0)).alias(name)
    return stored.select("repo", "scan_id", "scan_type", "duration_ms", "total_files", "total_issues",
                         get("by_severity", "Error", "errors"), get("by_category", "CORS Configuration", "cors"))


@query("snk08_history_text", f"""WITH {LEAKS} SELECT repo, sha, path, line, code, 'commit ' || sha[1:12] || ' - ' || author AS commit,
  '  [' || severity || '] ' || code || '  ' || path || ':' || line || chr(10) || '    ' || message || chr(10) || '    match: ' || CASE WHEN length(match) > 80 THEN match[1:77] || '...' ELSE match END AS text FROM leaks""")
def history_export(spark, sf):
    return export.history_text(history.history_findings(sql_table(spark, sf, inputs.PATCHES)))


@query("snk08_history_json", f"WITH {LEAKS} SELECT sha AS \"commitSha\", path AS \"filePath\", line AS \"lineNumber\", code AS \"ruleCode\", severity, match FROM leaks")
def history_json_export(spark, sf):
    rows = export.history_json(history.history_findings(sql_table(spark, sf, inputs.PATCHES)))
    doc = F.from_json("json", "commitSha string, filePath string, lineNumber int, ruleCode string, severity string, match string")
    return rows.select(doc.alias("d")).select("d.*")


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A stored table as a stream, be it one file or a folder of them; text tables are spread over the cores."""
    stored = spark.read.parquet(f"{sf}/{name}.parquet")
    # A pattern is taken for a list of files or folders, where a plain path has to be a folder.
    stream = spark.readStream.schema(stored.schema).parquet(f"{sf}/{name}.parque[t]")
    tasks = tasks_wanted(stored) if name in corpus.TEXTS else None
    return stream.repartition(tasks) if tasks else stream


class _Store:
    """A sink that appends each batch to a table in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.schema = spark, shared_folder(spark), None

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.schema = batch.schema
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")

    def run(self, writer, keep_batch: bool = False) -> DataFrame:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        schema = StructType([*self.schema.fields, StructField("batch", LongType())]) if keep_batch else self.schema
        rows = self.spark.read.schema(schema).parquet(self.folder)
        return rows if keep_batch else rows.drop("batch")


def _versions(spark, sf, edited: bool = False) -> DataFrame:
    """A stream of file versions: an early one with other content, then the real one."""
    docs = _stream(spark, sf, "documents")
    code = corpus.code_from(spark, docs)
    final = sql_table(spark, sf, inputs.EDITED, files=code) if edited else code
    both = F.array(
        F.struct(F.lit(1).alias("ts"), F.concat(F.lit("isAdmin: true // draft\n"), "content").alias("content")),
        F.struct(F.lit(2).alias("ts"), F.col("content").alias("content")),
    )
    return final.select("repo", "path", "language", F.explode(both).alias("v")).select("repo", "path", "language", "v.*")


@query("str01_scan_stream", ORACLES["set01_all_findings"])
def scan_stream(spark, sf):
    store = _Store(spark)
    writer = jobs.scan_stream(_versions(spark, sf), store, shared_folder(spark))
    return store.run(writer).select("repo", "path", "line", "code", "severity", "pattern")


_DAY = "SELECT strftime(ts, '%Y-%m-%d') AS day, code, " + ", ".join(
    f"count(*) FILTER (action = '{a}') AS {n}" for a, n in (("detected", "detections"), ("fixed", "fixed"), ("false_positive", "fps"),
                                                            ("verified", "verified"), ("ignored", "ignored"), ("fix_failed", "fix_failed"))
) + " FROM actions GROUP BY ALL"


@query("str02_rule_counters", f"WITH {ACTIONS} {_DAY}")
def rule_counters(spark, sf):
    """Daily counters over the action stream. Each batch brings the days that changed; the newest row of a day and rule counts."""
    events = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    log = sql_table(spark, sf, inputs.ACTIONS, events=events)
    store = _Store(spark)

    writer = jobs.daily_rule_counters(log).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", shared_folder(spark))
    rows = store.run(writer, keep_batch=True)
    values = [c for c in rows.columns if c not in ("day", "code", "batch")]
    newest = rows.groupBy("day", "code").agg(F.max_by(F.struct(*values), "batch").alias("n")).select("day", "code", "n.*")
    return newest.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("str02_bucket_counters", f"WITH {ACTIONS}, {_BUCKETS} SELECT code, bucket, bucket_detections AS detections, bucket_fps AS fps FROM buckets")
def bucket_counters(spark, sf):
    """Running counters per rule and path bucket; there is a fixed number of both."""
    log = sql_table(spark, sf, inputs.ACTIONS, events=_stream(spark, sf, "events"))
    store = _Store(spark)
    writer = jobs.bucket_counters(log).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", shared_folder(spark))
    rows = store.run(writer, keep_batch=True)
    return rows.groupBy("code", "bucket").agg(F.max_by(F.struct("detections", "fps"), "batch").alias("n")).select("code", "bucket", "n.*")


_KEY = "repo, path, code, line, pattern"
FLOW_CODES = sorted({s.code for s in SINKS})


_NEW_FLOWS = f"(WITH {corpus.CODE},{lines_sql()}, {TAINT} SELECT {_KEY} FROM taint_findings)".replace(corpus.CODE, "\n  files AS (SELECT * FROM new_files)")


@query("str03_verify_stream", f"""WITH {inputs.NEW_FINDINGS_ALL}, {inputs.STATUS_SQL}, {TAINT},
  old_all AS (SELECT {_KEY} FROM findings UNION SELECT {_KEY} FROM taint_findings), new_all AS (SELECT {_KEY} FROM new_findings UNION SELECT {_KEY} FROM {_NEW_FLOWS}),
  gone AS (SELECT {_KEY} FROM old_all EXCEPT SELECT {_KEY} FROM new_all)
SELECT {_KEY} FROM gone g WHERE (g.line = 0 OR NOT EXISTS (SELECT 1 FROM new_all n WHERE n.repo = g.repo AND n.path = g.path AND n.code = g.code AND n.pattern = g.pattern))
  AND NOT EXISTS (SELECT 1 FROM statuses s WHERE s.status IN ('verified', 'ignored') AND s.repo = g.repo AND s.path = g.path AND s.code = g.code AND s.line = g.line AND s.pattern = g.pattern)""")
def verify_stream(spark, sf):
    """Resolved findings of rules and flows. The files are scanned once for what was found before, and the statuses are those of its rules' findings."""
    old = written(scan(corpus.code(spark, sf)))
    known = written(inputs.statuses(spark, sf, old.where(~F.col("code").isin(FLOW_CODES))))
    store = _Store(spark)
    writer = jobs.verify_stream(_versions(spark, sf, edited=True), lambda: old, lambda: known, store, shared_folder(spark))
    return store.run(writer)


_VERIFIED = "SELECT DISTINCT repo, path, code, 'verified' AS status, TIMESTAMP '2024-01-01 00:00:00' AS at FROM {actions} WHERE action = 'verified' AND language = 'java'"


@query("str04_regression_stream", f"WITH {ACTIONS}, v AS ({duck(_VERIFIED, 'actions')}) SELECT event_id, a.repo, a.path, a.code FROM actions a JOIN v USING (repo, path, code) WHERE action = 'detected'")
def regression_stream(spark, sf):
    log = sql_table(spark, sf, inputs.ACTIONS, events=_stream(spark, sf, "events"))
    verified = sql_table(spark, sf, _VERIFIED, actions=sql_table(spark, sf, inputs.ACTIONS))
    joined = jobs.regression_stream(log.where(F.col("action") == "detected"), verified).select("event_id", "repo", "path", "code")
    store = _Store(spark)
    return store.run(joined.writeStream.foreachBatch(store).option("checkpointLocation", shared_folder(spark)))


@query("str05_overdue_sweep", f"""WITH {_SWEPT} SELECT repo, task_id, CASE WHEN s1 IN ('pending', 'completed') AND next_due_at <= {inputs.NOW} THEN 'overdue' ELSE s1 END AS status,
  s1 IN ('pending', 'completed') AND next_due_at <= {inputs.NOW} AS newly_overdue FROM s""")
def overdue_sweep(spark, sf):
    store = _Store(spark)
    read = lambda: sql_table(spark, sf, inputs.TASKS)

    def last(batch: DataFrame, number: int) -> None:
        store(batch, 0)

    writer = jobs.overdue_sweep(_stream(spark, sf, "events"), read, last, shared_folder(spark), F.expr(inputs.NOW))
    return store.run(writer).select("repo", "task_id", "status", "newly_overdue")


@query("str06_dependency_stream", f"WITH {VULNERABLE} SELECT repo, dir, manifest, name, version, id, severity FROM vulnerable")
def dependency_stream(spark, sf):
    stream = sql_table(spark, sf, inputs.MANIFESTS, customer=_stream(spark, sf, "customer")).withColumn("ts", F.lit(1))
    store = _Store(spark)
    writer = jobs.dependency_stream(stream, advisories_of(spark, sf), store, shared_folder(spark))
    return store.run(writer).select("repo", "dir", "manifest", "name", "version", "id", "severity")
