"""Queries over files, changes, patches, manifests, reports and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.workspace import shared_folder
from ..sources import changes, files, manifests, policies, reports
from . import corpus, inputs
from .corpus import duck, lit, lines_sql, sql_table
from .registry import query

_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_EXT = f"lower(regexp_extract({_BASE}, '^.+\\.([^.]*)$', 1))"
_EXTS = ", ".join(lit(e) for e in files.EXTENSIONS)
_NAMES = ", ".join(lit(n) for n in files.FILE_NAMES)
_SKIP = "|".join(f.replace(".", "\\.") for f in [*files.SKIPPED_FOLDERS, "infra"])
PLACES = f"places AS ({duck(inputs.PLACES)})"
HEADED = f"files AS ({duck(inputs.HEADED)})"


@query("src01_eligible_files", f"""WITH {PLACES} SELECT repo, path FROM places
WHERE ({_EXT} IN ({_EXTS}) OR {_BASE} IN ({_NAMES}) OR contains(path, 'notes'))
  AND NOT regexp_matches(path, '(^|/)(?:{_SKIP})/')""")
def eligible_files(spark, sf):
    places = sql_table(spark, sf, inputs.PLACES)
    return places.where(files.eligible(F.col("path"), ["infra"], ["notes"])).select("repo", "path")


_LANG = " ".join(f"WHEN {lit(e)} THEN {lit(l)}" for e, l in files.EXTENSION_LANGUAGE.items())


@query("src02_language", f"""WITH {PLACES} SELECT repo, path, CASE WHEN {_BASE} IN ({_NAMES}) THEN 'dockerfile'
  ELSE CASE {_EXT} {_LANG} ELSE {_EXT} END END AS language FROM places""")
def languages(spark, sf):
    return sql_table(spark, sf, inputs.PLACES).select("repo", "path", files.language(F.col("path")).alias("language"))


@query("src03_size_guard", """SELECT doc_id, octet_length(encode(text)) <= 2000 AS by_bytes, length(text) <= 2000 AS by_chars, TRUE AS no_limit FROM documents""")
def size_guard(spark, sf):
    return corpus.table(spark, sf, "documents").select(
        "doc_id", files.within_size(F.col("text"), 2000).alias("by_bytes"),
        files.within_size(F.col("text"), 2000, "characters").alias("by_chars"), files.within_size(F.col("text"), 0).alias("no_limit"),
    )


_GENERATED = lit("|".join(f"(?:{p})" for p in files.GENERATED_PATHS))


@query("src04_generated_paths", f"WITH {PLACES} SELECT repo, path, regexp_matches(lower(path), {_GENERATED}) AS generated FROM places")
def generated_paths(spark, sf):
    return sql_table(spark, sf, inputs.PLACES).select("repo", "path", files.generated_by_path(F.col("path")).alias("generated"))


_MARKS = lit("(?i)" + "|".join(f"(?:{p})" for p in files.GENERATED_MARKS))


@query("src05_generated_content", f"WITH {HEADED} SELECT repo, path, regexp_matches(content[1:500], {_MARKS}) AS generated FROM files")
def generated_content(spark, sf):
    return sql_table(spark, sf, inputs.HEADED).select("repo", "path", files.generated_by_content(F.col("content")).alias("generated"))


_SHAPES = lit("|".join(files.MINIFIED_SHAPES))


@query("src06_minified", f"""WITH {HEADED}, heads AS (SELECT repo, path, content[1:1000] AS s FROM files)
SELECT repo, path, CASE WHEN NOT contains(s, chr(10)) THEN length(s) > 500
  ELSE length(s) / len(string_split(s, chr(10))) > 300 OR regexp_matches(s, {_SHAPES}) END AS minified FROM heads""")
def minified_files(spark, sf):
    return sql_table(spark, sf, inputs.HEADED).select("repo", "path", files.minified(F.col("content")).alias("minified"))


SKIPPED = f"""heads AS (SELECT repo, path, content, content[1:1000] AS s FROM files),
  judged AS (SELECT repo, path, content, CASE WHEN octet_length(encode(content)) > {files.MAX_FILE_SIZE} THEN 'size'
      WHEN regexp_matches(lower(path), {_GENERATED}) OR regexp_matches(content[1:500], {_MARKS}) THEN 'generated'
      WHEN CASE WHEN NOT contains(s, chr(10)) THEN length(s) > 500 ELSE length(s) / len(string_split(s, chr(10))) > 300 OR regexp_matches(s, {_SHAPES}) END THEN 'minified' END AS reason FROM heads),
  cut AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line FROM judged WHERE reason IS NULL),
  skipped AS (SELECT repo, path, CAST(NULL AS INT) AS line, reason FROM judged WHERE reason IS NOT NULL UNION ALL SELECT repo, path, line::INT, 'line length' FROM cut WHERE length(text) > 2000)"""


@query("src05_skipped", f"WITH {HEADED}, {SKIPPED} SELECT * FROM skipped")
def skipped(spark, sf):
    """What the limits of an interactive scan leave out, with the reason."""
    return files.skipped(sql_table(spark, sf, inputs.HEADED))


@query("src05_skipped_documents", f"WITH {corpus.DOCUMENTS}, {SKIPPED} SELECT * FROM skipped")
def skipped_documents(spark, sf):
    return files.skipped(corpus.documents(spark, sf))


@query("src01_read_files", "SELECT 'docs' AS repo, doc_id, 'txt' AS language, sha256(text || chr(10)) AS content_sha256, octet_length(encode(text)) + 1 AS size FROM documents")
def read_back(spark, sf):
    """Documents stored as a file each, then listed, chosen and read again."""
    folder = shared_folder(spark)
    name, text = F.concat(F.lit("doc="), F.col("doc_id").cast("string"), F.lit(".txt")), F.coalesce("text", F.lit(""))
    files.write_files(corpus.table(spark, sf, "documents").select(name.alias("name"), F.concat(text, F.lit("\n")).alias("content")), folder)
    found = files.read_files(spark, folder, "docs", includes=["part-"])
    doc_id = F.regexp_extract("path", "doc=([0-9]+)[.]txt$", 1).cast("long")
    return found.select("repo", doc_id.alias("doc_id"), "language", F.sha2("content", 256).alias("content_sha256"), "size")


@query("src07_lines", f"WITH {corpus.DOCUMENTS},{lines_sql()} SELECT repo, path, line, text FROM lines")
def all_lines(spark, sf):
    return files.lines(corpus.documents(spark, sf)).select("repo", "path", "line", "text")


@query("src08_short_lines", f"WITH {corpus.DOCUMENTS},{lines_sql()} SELECT repo, path, line, text FROM lines WHERE length(text) <= 200")
def short_lines(spark, sf):
    return files.short_lines(files.lines(corpus.documents(spark, sf)), 200).select("repo", "path", "line", "text")


@query("src09_changed_since", f"""WITH {corpus.DOCUMENTS}, changes AS ({duck(inputs.CHANGES)})
SELECT repo, path FROM files f WHERE EXISTS (SELECT 1 FROM changes c WHERE c.repo = f.repo AND c.path = f.path AND c.status <> 'D')""")
def changed_files(spark, sf):
    return changes.changed_since(corpus.documents(spark, sf), sql_table(spark, sf, inputs.CHANGES)).select("repo", "path")


@query("src10_uncommitted", f"""WITH changes AS ({duck(inputs.CHANGES)})
SELECT DISTINCT repo, path FROM changes WHERE kind IN ('modified', 'staged', 'untracked')""")
def uncommitted_files(spark, sf):
    return changes.uncommitted(sql_table(spark, sf, inputs.CHANGES))


@query("src11_branch_files", f"""WITH {corpus.DOCUMENTS}, commits AS ({duck(inputs.COMMITS)})
SELECT repo, path FROM files WHERE language = 'text' AND (repo, path) IN
  (SELECT (repo, path) FROM commits WHERE branch NOT IN ('main', 'master') AND base_seq IS NOT NULL AND seq > base_seq)""")
def branch_files(spark, sf):
    commits = sql_table(spark, sf, inputs.COMMITS)
    return changes.branch_files(corpus.documents(spark, sf), commits, ["text"]).select("repo", "path")


@query("src12_file_changes", f"""WITH n AS ({duck(inputs.NOW_FILES)}), o AS ({duck(inputs.THEN_FILES)})
SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.path, o.path) AS path,
  CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted'
       WHEN n.mtime = o.mtime AND strlen(n.content) = strlen(o.content) THEN 'unchanged'
       WHEN strlen(n.content) <> strlen(o.content) THEN 'modified'
       WHEN n.content = o.content THEN 'unchanged' ELSE 'modified' END AS status
FROM n FULL JOIN o ON n.repo = o.repo AND n.path = o.path""")
def file_changes(spark, sf):
    state = sql_table(spark, sf, inputs.THEN_FILES).withColumn("language", F.lit("x"))
    return files.file_changes(sql_table(spark, sf, inputs.NOW_FILES), files.file_snapshot(state, F.current_timestamp()))


@query("src13_file_snapshot", f"""WITH n AS ({duck(inputs.NOW_FILES)})
SELECT repo, path, strlen(content) AS size, mtime, sha256(content) AS content_hash FROM n""")
def file_snapshot(spark, sf):
    now = sql_table(spark, sf, inputs.NOW_FILES).withColumn("language", F.lit("x"))
    return files.file_snapshot(now, F.current_timestamp()).select("repo", "path", "size", "mtime", "content_hash")


# An independent reading of a patch: walk its lines with windows.
ADDED = f"""patches AS ({duck(inputs.PATCHES)}),
  raw AS (SELECT repo, sha, author, committed_at, unnest(string_split(patch, chr(10))) AS l, generate_subscripts(string_split(patch, chr(10)), 1) AS i FROM patches),
  marked AS (SELECT *, CASE WHEN l LIKE 'diff --git%' THEN i END AS file_at, CASE WHEN l LIKE 'diff --git%' THEN regexp_extract(l, '^diff --git a/(.+?) b/(.+)$', 2) END AS file,
      CASE WHEN regexp_matches(l, '^@@ -\\d+(?:,\\d+)? \\+\\d+(?:,\\d+)? @@') THEN i END AS hunk_at,
      CAST(nullif(regexp_extract(l, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@', 1), '') AS INT) AS start FROM raw),
  walked AS (SELECT *, last_value(file IGNORE NULLS) OVER w AS path, last_value(hunk_at IGNORE NULLS) OVER w AS hunk, last_value(start IGNORE NULLS) OVER w AS first_line FROM marked
      WINDOW w AS (PARTITION BY repo, sha ORDER BY i ROWS UNBOUNDED PRECEDING)),
  counted AS (SELECT *, sum(CASE WHEN l LIKE ' %' OR (l LIKE '+%' AND l NOT LIKE '+++%') THEN 1 ELSE 0 END) OVER (PARTITION BY repo, sha, hunk ORDER BY i ROWS UNBOUNDED PRECEDING) AS seen FROM walked),
  added AS (SELECT repo, sha, author, committed_at, path, (first_line + seen - 1)::INT AS line, l[2:] AS text FROM counted
      WHERE l LIKE '+%' AND l NOT LIKE '+++%' AND hunk IS NOT NULL)"""


@query("src14_added_lines", f"WITH {ADDED} SELECT repo, sha, path, line, text FROM added")
def added_lines(spark, sf):
    return changes.added_lines(sql_table(spark, sf, inputs.PATCHES)).select("repo", "sha", "path", "line", "text")


@query("src15_latest_commits", f"""WITH patches AS ({duck(inputs.PATCHES)})
SELECT repo, sha FROM patches QUALIFY row_number() OVER (PARTITION BY repo ORDER BY committed_at DESC, sha) <= 3""")
def latest_commits(spark, sf):
    return changes.latest_commits(sql_table(spark, sf, inputs.PATCHES), 3).select("repo", "sha")


_MANIFEST = f"manifests AS ({duck(inputs.MANIFESTS)})"
_L = "SELECT repo, dir, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM manifests WHERE file = "


def _manifest(key: str, file: str, sql: str):
    def parsed(spark, sf):
        rows = manifests.package_rows(sql_table(spark, sf, inputs.MANIFESTS).where(F.col("file") == file))
        return rows.select("repo", "dir", "ecosystem", "name", "version")

    query(key, sql)(parsed)


_REQ = r"^([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*==\s*([0-9][A-Za-z0-9.+!_-]*)$"
_manifest("src16_requirements", "requirements.txt", f"""WITH {_MANIFEST}, raw AS ({_L}'requirements.txt'),
  pins AS (SELECT repo, dir, trim(string_split(trim(regexp_replace(l, '#.*$', '')), ';')[1]) AS p FROM raw)
SELECT repo, dir, 'PyPI' AS ecosystem, regexp_extract(p, {lit(_REQ)}, 1) AS name, regexp_extract(p, {lit(_REQ)}, 2) AS version FROM pins WHERE regexp_matches(p, {lit(_REQ)})""")

_manifest("src17_go_mod", "go.mod", f"""WITH {_MANIFEST}, raw AS ({_L}'go.mod'), clean AS (SELECT repo, dir, i, trim(regexp_replace(l, '//.*$', '')) AS l FROM raw),
  state AS (SELECT *, last_value(CASE WHEN regexp_matches(l, '^require\\s*\\($') THEN 1 WHEN l = ')' THEN 0 END IGNORE NULLS) OVER (PARTITION BY repo, dir ORDER BY i ROWS UNBOUNDED PRECEDING) AS inside FROM clean)
SELECT repo, dir, 'Go' AS ecosystem, regexp_extract(l, '^(?:require\\s+)?(\\S+)\\s+v([0-9]\\S*)$', 1) AS name, regexp_extract(l, '^(?:require\\s+)?(\\S+)\\s+v([0-9]\\S*)$', 2) AS version
FROM state WHERE (inside = 1 AND regexp_matches(l, '^\\S+\\s+v[0-9]\\S*$')) OR (coalesce(inside, 0) = 0 AND regexp_matches(l, '^require\\s+\\S+\\s+v[0-9]\\S*$'))""")

_manifest("src18_cargo_lock", "Cargo.lock", f"""WITH {_MANIFEST}, blocks AS (SELECT repo, dir, unnest(string_split(content, '[[package]]')[2:]) AS b FROM manifests WHERE file = 'Cargo.lock')
SELECT repo, dir, 'crates.io' AS ecosystem, regexp_extract(b, '(?m)^\\s*name\\s*=\\s*"([^"]+)"', 1) AS name, regexp_extract(b, '(?m)^\\s*version\\s*=\\s*"([^"]+)"', 1) AS version
FROM blocks WHERE regexp_matches(b, '(?m)^\\s*name\\s*=\\s*"[^"]+"') AND regexp_matches(b, '(?m)^\\s*version\\s*=\\s*"[^"]+"')""")

_manifest("src19_cargo_toml", "Cargo.toml", f"""WITH {_MANIFEST}, raw AS ({_L}'Cargo.toml'), clean AS (SELECT repo, dir, i, trim(regexp_replace(l, '#.*$', '')) AS l FROM raw),
  state AS (SELECT *, last_value(nullif(regexp_extract(l, '^\\[([^\\]]+)\\]$', 1), '') IGNORE NULLS) OVER (PARTITION BY repo, dir ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM clean),
  found AS (SELECT repo, dir, regexp_extract(l, '^([A-Za-z0-9._-]+)\\s*=', 1) AS name,
      regexp_replace(CASE WHEN regexp_matches(l, '^[A-Za-z0-9._-]+\\s*=\\s*"[^"]+"$') THEN regexp_extract(l, '"([^"]+)"', 1) ELSE regexp_extract(l, '\\{{.*version\\s*=\\s*"([^"]+)".*\\}}$', 1) END, '^[\\^~=\\s]+', '') AS version
      FROM state WHERE regexp_matches(section, '^(?:workspace\\.)?(?:dependencies|dev-dependencies|build-dependencies)$'))
SELECT repo, dir, 'crates.io' AS ecosystem, name, version FROM found WHERE regexp_matches(version, '^\\d+(\\.\\d+){{0,2}}([.+-][A-Za-z0-9.]+)?$')""")

_manifest("src20_pom", "pom.xml", f"""WITH {_MANIFEST}, deps AS (SELECT repo, dir, content, unnest(regexp_extract_all(content, '(?s)<dependency>(.*?)</dependency>', 1)) AS d FROM manifests WHERE file = 'pom.xml'),
  tags AS (SELECT *, regexp_extract(d, '<groupId>([^<]+)</groupId>', 1) AS g, regexp_extract(d, '<artifactId>([^<]+)</artifactId>', 1) AS a, trim(regexp_extract(d, '<version>([^<]+)</version>', 1)) AS v FROM deps),
  solved AS (SELECT repo, dir, g || ':' || a AS name, CASE v WHEN '${{v.a}}' THEN trim(regexp_extract(content, '<v\\.a>([^<]+)</v\\.a>', 1)) WHEN '${{v.b}}' THEN trim(regexp_extract(content, '<v\\.b>([^<]+)</v\\.b>', 1)) ELSE v END AS version FROM tags)
SELECT repo, dir, 'Maven' AS ecosystem, name, version FROM solved WHERE regexp_matches(version, '^\\d')""")

_manifest("src21_gemfile_lock", "Gemfile.lock", f"""WITH {_MANIFEST}, raw AS ({_L}'Gemfile.lock'),
  state AS (SELECT *, last_value(CASE WHEN regexp_matches(l, '^[A-Z]') THEN l END IGNORE NULLS) OVER (PARTITION BY repo, dir ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM raw)
SELECT repo, dir, 'RubyGems' AS ecosystem, regexp_extract(l, '^    ([A-Za-z0-9._-]+) \\(([0-9][A-Za-z0-9.]*)', 1) AS name, regexp_extract(l, '^    ([A-Za-z0-9._-]+) \\(([0-9][A-Za-z0-9.]*)', 2) AS version
FROM state WHERE section = 'GEM' AND regexp_matches(l, '^    [A-Za-z0-9._-]+ \\([0-9]')""")

_manifest("src22_composer_lock", "composer.lock", f"""WITH {_MANIFEST}, docs AS (SELECT repo, dir, content::JSON AS j FROM manifests WHERE file = 'composer.lock' AND json_valid(content)),
  p AS (SELECT repo, dir, unnest(CAST(j->'$.packages' AS JSON[])) AS x FROM docs UNION ALL SELECT repo, dir, unnest(CAST(j->'$.packages-dev' AS JSON[])) FROM docs)
SELECT repo, dir, 'Packagist' AS ecosystem, x->>'$.name' AS name, regexp_replace(x->>'$.version', '^v', '') AS version FROM p WHERE x->>'$.name' IS NOT NULL AND x->>'$.version' IS NOT NULL""")


@query("src23_preferred_manifests", f"""WITH {_MANIFEST}, known AS (SELECT * FROM manifests WHERE file <> 'README.md')
SELECT repo, dir, file, file = 'composer.lock' AND NOT json_valid(content) AS broken FROM known k
WHERE NOT (file = 'Cargo.toml' AND EXISTS (SELECT 1 FROM known o WHERE o.repo = k.repo AND o.dir = k.dir AND o.file = 'Cargo.lock'))""")
def preferred_manifests(spark, sf):
    source = sql_table(spark, sf, inputs.MANIFESTS)
    broken = manifests.manifest_errors(source).withColumn("broken", F.lit(True))
    kept = manifests.preferred_manifests(source).select("repo", "dir", "file")
    return kept.join(broken, ["repo", "dir", "file"], "left").withColumn("broken", F.coalesce("broken", F.lit(False)))


@query("src24_advisory_feed", f"""WITH feed AS ({duck(inputs.FEED)})
SELECT body->>'$.id' AS id, body->>'$.summary' AS summary, body->>'$.affected[0].package.name' AS name, body->>'$.affected[0].ranges[0].events[1].fixed' AS fixed,
  body->>'$.database_specific.severity' AS stated FROM (SELECT body::JSON AS body FROM feed)""")
def advisory_feed(spark, sf):
    a = reports.parse_advisories(sql_table(spark, sf, inputs.FEED))
    first = F.col("affected")[0]
    return a.select("id", "summary", first["package"]["name"].alias("name"), first["ranges"][0]["events"][1]["fixed"].alias("fixed"),
                    F.col("database_specific.severity").alias("stated"))


REPORTS_SQL = f"reports AS ({duck(inputs.REPORTS)})"
_SEMVER = lambda v, i: f"nullif(regexp_extract({v}, '^[v^~>=<\\s]*(\\d+)\\.(\\d+)\\.(\\d+)', {i}), '')"


def update_type_sql(a: str, b: str) -> str:
    p = lambda i: f"{_SEMVER(a, i)}::BIGINT <> {_SEMVER(b, i)}::BIGINT"
    return (f"CASE WHEN {_SEMVER(a, 1)} IS NULL OR {_SEMVER(b, 1)} IS NULL THEN 'unknown' WHEN {p(1)} THEN 'major'"
            f" WHEN {p(2)} THEN 'minor' WHEN {p(3)} THEN 'patch' ELSE 'unknown' END")


OUTDATED = f"""outdated AS (SELECT repo, k AS name, coalesce(nullif(p->>'$.current', ''), 'N/A') AS current, coalesce(nullif(p->>'$.wanted', ''), 'N/A') AS wanted,
    coalesce(nullif(p->>'$.latest', ''), 'N/A') AS latest, CASE WHEN p->>'$.type' = 'devDependencies' THEN 'devDependencies' ELSE 'dependencies' END AS type,
    {update_type_sql("coalesce(p->>'$.current', '')", "coalesce(p->>'$.latest', '')")} AS update_type
  FROM (SELECT repo, k, body->k AS p FROM (SELECT repo, body::JSON AS body, unnest(json_keys(body)) AS k FROM reports WHERE kind = 'outdated')))"""


@query("src25_outdated_report", f"WITH {REPORTS_SQL}, {OUTDATED} SELECT * FROM outdated")
def outdated_report(spark, sf):
    return reports.outdated(sql_table(spark, sf, inputs.REPORTS))


AUDIT = """audit AS (SELECT repo, k AS name, coalesce(p->>'$.severity', 'info') AS severity, coalesce(t->>'$.title', 'Vulnerability in ' || k) AS title, coalesce(t->>'$.url', '') AS url,
    coalesce(t->>'$.range', p->>'$.range', '') AS range, coalesce(p->>'$.fixAvailable', 'false') <> 'false' AS fix_available
  FROM (SELECT repo, k, p, list_filter(CAST(p->'$.via' AS JSON[]), lambda x: json_type(x) = 'OBJECT')[1] AS t
        FROM (SELECT repo, k, v->k AS p FROM (SELECT repo, body::JSON->'$.vulnerabilities' AS v, unnest(json_keys(body::JSON->'$.vulnerabilities')) AS k FROM reports WHERE kind = 'audit')))
  UNION ALL
  SELECT repo, p->>'$.module_name', p->>'$.severity', p->>'$.title', p->>'$.url', p->>'$.vulnerable_versions', p->>'$.patched_versions' <> '<0.0.0'
  FROM (SELECT repo, v->k AS p FROM (SELECT repo, body::JSON->'$.advisories' AS v, unnest(json_keys(body::JSON->'$.advisories')) AS k FROM reports WHERE kind = 'audit')))"""


@query("src26_audit_report", f"WITH {REPORTS_SQL}, {AUDIT} SELECT * FROM audit")
def audit_report(spark, sf):
    return reports.audit(sql_table(spark, sf, inputs.REPORTS))


IGNORES = f"""ignore_files AS ({duck(inputs.IGNORE_FILES)}),
  ignore_raw AS (SELECT repo, trim(unnest(string_split(content, chr(10)))) AS l FROM ignore_files),
  ignore_parts AS (SELECT repo, l, regexp_split_to_array(trim(string_split(l, '#')[1]), '\\s+') AS p FROM ignore_raw WHERE l <> '' AND l NOT LIKE '#%'),
  ignore_spec AS (SELECT repo, p[1] AS code, p[2] AS spec, TRY_CAST(regexp_extract(p[2], ':([0-9]+)$', 1) AS INT) AS n,
      CASE WHEN contains(l, '#') THEN nullif(trim(regexp_extract(l, '#(.*)$', 1)), '') END AS reason FROM ignore_parts WHERE len(p) >= 2),
  ignores AS (SELECT repo, code, replace(CASE WHEN n > 0 THEN regexp_replace(spec, ':[0-9]+$', '') ELSE spec END, chr(92), '/') AS path, CASE WHEN n > 0 THEN n END AS line, reason FROM ignore_spec)"""


@query("src27_ignore_file", f"WITH {IGNORES} SELECT * FROM ignores")
def ignore_file(spark, sf):
    return policies.ignore_entries(sql_table(spark, sf, inputs.IGNORE_FILES))


BASELINE = f"""baseline_files AS ({duck(inputs.BASELINE_FILES)}),
  baseline AS (SELECT repo, path, code, CAST(c->code AS INT) AS n FROM (SELECT repo, path, c, unnest(json_keys(c)) AS code FROM
      (SELECT repo, path, j->path AS c FROM (SELECT repo, content::JSON->'$.counts' AS j, unnest(json_keys(content::JSON->'$.counts')) AS path FROM baseline_files))))"""


@query("src28_baseline_file", f"WITH {BASELINE} SELECT * FROM baseline")
def baseline_file(spark, sf):
    return policies.baseline_entries(sql_table(spark, sf, inputs.BASELINE_FILES))
