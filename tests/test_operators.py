"""Operators on small tables whose results can be read off."""

import json
import random
import re
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seclake.functions.versions import in_range, version_key
from seclake.operators import documents, export, fixes, lifecycle, scope, suppression
from seclake.operators.dependencies import versions_hit, vulnerable_packages
from seclake.operators.joining import meet
from seclake.operators.learning import bucket_stats, language_stats, rule_stats, safe_helpers
from seclake.operators.learning_store import LearningStore, bucket_stats_of, language_stats_of, merged
from seclake.operators.statistics import security_score
from seclake.plans.workspace import shared_folder
from seclake.sources import changes, manifests, policies, reports
from seclake.sources.files import content_hash, file_changes, language, read_files, spread

FINDING = "repo string, path string, language string, line int, col int, code string, severity int, category string, message string, suggestion string, pattern string"


def findings(spark, *rows):
    full = [("r", path, "x", line, 0, code, severity, "api-security", "m", "s", pattern) for path, line, code, severity, pattern in rows]
    return spark.createDataFrame(full, FINDING)


def test_refused_files_are_never_opened(spark, tmp_path):
    """Contents above a limit of the reader end the query, unless the listing leaves their files out."""
    names = ["src/a b+c%20é.js", "deep/er/z.ts", "k.py", "src/big.js", "node_modules/x/y.js", "docs/big.md"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * (5000 if "big" in name or "node_modules" in name else 10))
    small = set(names[:3])
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        paths = lambda df: {r.path for r in df.collect()}
        assert paths(read_files(spark, str(tmp_path), "r", max_size=1000)) == small
        assert paths(read_files(spark, f"file://{tmp_path}/", "r").where("path NOT LIKE '%big%'")) == small
        assert paths(read_files(spark, str(tmp_path), "r").where("language = 'python'")) == {"k.py"}
        assert paths(read_files(spark, str(tmp_path), "r").where("size < 1000")) == small
        assert read_files(spark, str(tmp_path), "r").select("path", "language", "size", "mtime").count() == 4
        with pytest.raises(Exception, match="big.js"):
            read_files(spark, str(tmp_path), "r").collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_read_files(spark, tmp_path):
    for name, text in {"src/a.js": "x", "node_modules/b.js": "y", "Dockerfile": "FROM a", "docs/c.md": "z", "keep/notes.md": "n", "e.min.bin": "q"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {(r.path, r.language, r.content) for r in read_files(spark, str(tmp_path), "r", includes=["notes"]).collect()}
    assert got == {("src/a.js", "javascript", "x"), ("Dockerfile", "dockerfile", "FROM a"), ("keep/notes.md", "md", "n")}


def test_spread_leaves_large_tables_alone(spark):
    big = spark.range(100, numPartitions=64)
    assert spread(big).rdd.getNumPartitions() == 64 and spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == 32


def test_versions(spark):
    pairs = [("1.10.0", "1.9.0", True), ("1.2.0", "1.2", False), ("1.0.0", "1.0.0-rc1", True), ("2.0", "10.0", False), ("v1.0.1", "1.0.0", True),
             ("1.0.0-rc2", "1.0.0-rc1", True), ("1.0.0-rc10", "1.0.0-rc9", True), ("1.0.0-beta", "1.0.0-rc1", False), ("1.2.3.4.5.6.8", "1.2.3.4.5.6.7", True),
             ("1.0.post1", "1.0", True), ("1.0a1", "1.0.dev3", True), ("1.0+build9", "1.0", False), ("1.0", "1.0.0+x", False), ("123456789012345678901", "9", True)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    assert [r[0] for r in df.select(version_key(F.col("a")) > version_key(F.col("b"))).collect()] == [p[2] for p in pairs]
    inside = spark.createDataFrame([("1.5.0",), ("2.0.0",), ("0.9",)], "v string")
    assert [r[0] for r in inside.select(in_range(F.col("v"), F.lit("1.0"), F.lit("2.0.0"))).collect()] == [True, False, False]


ADVISORIES = [
    # id, name, ecosystem, range type, events
    ("A1", "flask", "PyPI", "ECOSYSTEM", '{"introduced": "0"}, {"last_affected": "1.0"}'),
    ("A2", "flask", "PyPI", "GIT", '{"introduced": "0"}'),
    ("A3", "Typing_Extensions", "PyPI", "ECOSYSTEM", '{"introduced": "0"}, {"fixed": "2.0.0rc2"}'),
    ("A4", "x/y", "Go", "SEMVER", '{"introduced": "1.0.0"}, {"fixed": "1.5.0"}, {"introduced": "2.0.0"}, {"fixed": "2.1.0"}'),
]


def test_advisory_ranges(spark):
    body = '{"id": "%s", "affected": [{"package": {"name": "%s", "ecosystem": "%s"}, "ranges": [{"type": "%s", "events": [%s]}]}]}'
    feed = spark.createDataFrame([(body % a,) for a in ADVISORIES] + [("{broken",), ('{"no": "id"}',), (None,)], "body string")
    used = [("PyPI", "Flask", "3.0.0"), ("PyPI", "FLASK", "1.0"), ("PyPI", "flask", "0.9"), ("PyPI", "typing-extensions", "2.0.0rc1"), ("PyPI", "typing.extensions", "2.0.0rc2"),
            ("Go", "x/y", "1.4.9"), ("Go", "x/y", "1.5.0"), ("Go", "x/y", "2.0.5"), ("Go", "X/Y", "2.0.5")]
    packages = spark.createDataFrame([("r", "d", "m", *u) for u in used], "repo string, dir string, manifest string, ecosystem string, name string, version string")
    got = {(r.name, r.version, r.id) for r in vulnerable_packages(packages, reports.parse_advisories(feed)).collect()}
    assert got == {("FLASK", "1.0", "A1"), ("flask", "0.9", "A1"), ("typing-extensions", "2.0.0rc1", "A3"), ("x/y", "1.4.9", "A4"), ("x/y", "2.0.5", "A4")}
    assert sorted(r.reason for r in reports.rejected_advisories(feed).collect()) == ["no id", "not JSON", "not JSON"]


def test_bytes_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "a.js").write_bytes(b"caf\xe9 = eval(x)")
    (tmp_path / "b.js").write_bytes(b"y" * 3000)
    assert {r.path: r.content[:5] for r in read_files(spark, str(tmp_path), "r").collect()} == {"a.js": "caf\ufffd ", "b.js": "yyyyy"}
    assert [r.path for r in read_files(spark, str(tmp_path), "r", max_size=100, path_glob="*.js").collect()] == ["a.js"]


def test_baseline_shape_is_checked(spark):
    bad = spark.createDataFrame([("r", '{"version": 2, "counts": {}}')], "repo string, content string")
    good = spark.createDataFrame([("s", '{"version": 1, "counts": {"a": {"X": 2}}}'), ("t", "no json")], "repo string, content string")
    with pytest.raises(PySparkException):
        policies.baseline_entries(bad, strict=True).collect()
    assert {tuple(r) for r in policies.baseline_entries(bad.union(good)).collect()} == {("s", "a", "X", 2)}
    assert {tuple(r) for r in policies.rejected_baselines(bad.union(good)).collect()} == {("r", 2), ("t", None)}


def test_baseline_budget(spark):
    f = findings(spark, ("a", 1, "X", 1, "p"), ("a", 2, "X", 1, "p"), ("b\\c", 0, "Y", 1, "q"))
    b = spark.createDataFrame([("r", "a", "X", 1), ("r", "b/c", "Y", 5)], "repo string, path string, code string, n int")
    assert {(r.path, r.line, r.baselined) for r in suppression.apply_baseline(f, b).collect()} == {("a", 1, True), ("a", 2, False), ("b\\c", 0, True)}
    again = policies.baseline_entries(
        export.baseline_documents(suppression.build_baseline(f)).select("repo", F.col("json").alias("content")))
    assert {tuple(r) for r in again.collect()} == {("r", "a", "X", 2), ("r", "b/c", "Y", 1)}


def test_ignore_lines(spark):
    text = "# c\nA1 a\\b.js:3 # why\nA2 x y\nA3\nA4 c:d:0\n  \nA5 * #"
    got = {tuple(r) for r in policies.ignore_entries(spark.createDataFrame([("r", text)], "repo string, content string")).collect()}
    assert got == {("r", "A1", "a/b.js", 3, "why"), ("r", "A2", "x", None, None), ("r", "A4", "c:d:0", None, None), ("r", "A5", "*", None, None)}


def test_bulk_ignore_needs_the_option(spark):
    f = findings(spark, ("a", 1, "X", 1, "p"))
    star = spark.createDataFrame([("r", "X", "*", None, None)], "repo string, code string, path string, line int, reason string")
    assert suppression.without_ignored(f, star).count() == 1 and suppression.without_ignored(f, star, wildcard=True).count() == 0


def test_moved_findings_are_not_resolved(spark):
    old = findings(spark, ("a", 5, "X", 1, "p"), ("a", 0, "Z", 1, "z"), ("b", 3, "X", 1, "p"))
    new = findings(spark, ("a", 7, "X", 1, "p"), ("a", 2, "Z", 1, "z"))
    none = spark.createDataFrame([], "repo string, path string, code string, line int, pattern string, status string")
    got = {(r.path, r.line, r.code) for r in lifecycle.auto_verified(old, new, none).collect()}
    assert got == {("a", 0, "Z"), ("b", 3, "X")}


def test_regression_once_per_place(spark):
    new = findings(spark, ("a", 5, "X", 1, "p"), ("a", 5, "X", 1, "q"))
    done = spark.sql("SELECT 'r' repo, 'a' path, 'X' code, 1 line, 'p' pattern, 'verified' status, timestamp'2024-01-01' at"
                     " UNION ALL SELECT 'r', 'a', 'X', 2, 'p', 'verified', timestamp'2024-01-02'")
    known = spark.createDataFrame([], "repo string, path string, code string, line int")
    assert lifecycle.regressions(new, done, known).count() == 1


def test_score(spark, files):
    none = spark.createDataFrame([], "repo string, path string, code string, line int, pattern string, status string")
    f = findings(spark, ("a", 1, "X", 2, "p"), ("a", 2, "X", 0, "q"))
    row = security_score(files(("a", "x"), ("b", "y")), f, none).first()
    assert (row.files, row.open, row.penalty, row.score, row.grade) == (2, 2, 3.5, 91, "A")
    assert security_score(files(("a", "x")), f.where("false"), none).first().score == 100


def test_patch_lines(spark):
    patch = ("diff --git a/x b/y\nindex 1..2\n--- a/x\n+++ b/y\n@@ -1,2 +1,3 @@\n ctx\n+one\n-gone\n+++two\n+three\n"
             "@@ -9,0 +20 @@\n+four\ndiff --git a/z b/w v\n+before")
    rows = spark.createDataFrame([("r", "s", patch)], "repo string, sha string, patch string")
    assert {(r.path, r.line, r.text) for r in changes.added_lines(rows).collect()} == {
        ("y", 2, "one"), ("y", 3, "three"), ("y", 20, "four"), ("w v", 0, "before")}


def test_latest_commits_keep_whole_patches(spark):
    rows = spark.createDataFrame([("r", f"c{i}", i, f"p{j}") for i in range(5) for j in range(2)], "repo string, sha string, committed_at int, patch string")
    assert {(r.sha, r.patch) for r in changes.latest_commits(rows, 2).collect()} == {(f"c{i}", f"p{j}") for i in (3, 4) for j in range(2)}


def test_manifest_parsers(spark):
    docs = [("requirements.txt", "a==1.0 # c\nb>=2\n-e .\nC[x] == 3.0 ; y\n"), ("go.mod", "require x/y v1.2.3\nrequire (\n a/b v0.1 // i\n)\n"),
            ("Cargo.toml", '[package]\nversion = "9"\n[dependencies]\ns = "^1.0"\nt = { version = "0.3" }\nu = "*"\n'),
            ("Gemfile.lock", "GEM\n  specs:\n    r (7.0)\n      q (1)\n\nBUNDLED\n    z (1)"), ("composer.lock", "not json")]
    table = spark.createDataFrame([("r", f"d{i}", f, c) for i, (f, c) in enumerate(docs)], "repo string, dir string, file string, content string")
    assert {(r.ecosystem, r.name, r.version) for r in manifests.packages(table).collect()} == {
        ("PyPI", "a", "1.0"), ("PyPI", "C", "3.0"), ("Go", "x/y", "1.2.3"), ("Go", "a/b", "0.1"), ("crates.io", "s", "1.0"),
        ("crates.io", "t", "0.3"), ("RubyGems", "r", "7.0")}
    assert [r.file for r in manifests.manifest_errors(table).collect()] == ["composer.lock"]


FIXES = [
    ("K8S001", "  privileged: true", "  privileged: false", False), ("K8S002", "hostNetwork: true", None, True),
    ("K8S003", "hostIPC: true", None, True), ("K8S004", "runAsUser: 0", "runAsUser: 1000", False),
    ("K8S004", "allowPrivilegeEscalation: true", "allowPrivilegeEscalation: false", False),
    ("TF002", 'acl = "public-read"', 'acl = "private"', False), ("TF004", "publicly_accessible = true", "publicly_accessible = false", False),
    ("JWT002", "jwt.verify(t, k)", "jwt.verify(t, k, { algorithms: ['RS256'] })", False), ("JWT006", "{ a, ignoreExpiration: true }", "{ a}", False),
    ("DESER003", "yaml.unsafe_load(x)", "yaml.safe_load(x)", False), ("DESER004", "yaml.load(x)", "yaml.safe_load(x)", False),
    ("ENC004", "rejectUnauthorized: false", "rejectUnauthorized: true", False), ("DOCKER008", "  HEALTHCHECK NONE", "  # HEALTHCHECK NONE", False),
    ("CORS001", "origin: '*'", "origin: false", False),
]
NO_FIX = [("K8S001", "privileged: false"), ("K8S003", "x"), ("JWT002", "jwt.verify(t, k, { algorithms: [a] })"), ("DESER004", "yaml.load(x, Loader=yaml.SafeLoader)"),
          ("CORS001", "'Access-Control-Allow-Origin': '*'"), ("XSS001", "a.innerHTML = b")]


def test_rewrites(spark):
    df = spark.createDataFrame([(i, f[0], f[1]) for i, f in enumerate(FIXES + NO_FIX)], "i int, code string, text string")
    got = {r.i: (r.new_line, r.delete_line) for r in fixes.proposed_fixes(df).collect()}
    assert got == {i: f[2:] for i, f in enumerate(FIXES)}


def shape(line: str) -> str:
    """Plain reading of line shapes."""
    text = re.sub(r"(['\"`])(?:(?!\1|\\).|\\.)*\1", "$STRING", line.strip(" "))
    text = re.sub(r"\b\d+(?:\.\d+)?\b", "$NUM", text, flags=re.ASCII)
    names: dict[str, str] = {}

    def put(m):
        word = m.group(0)
        if word.startswith("$") or word in fixes.KEPT_WORDS:
            return word
        return names.setdefault(word, f"$VAR{len(names) + 1}")

    return re.sub(r"\$(?:STRING|NUM)(?![\w$])|\b[a-zA-Z_$][\w$]*\b", put, text, flags=re.ASCII)


def test_line_shapes(spark):
    r = random.Random(2)
    parts = ["const", "x", "foo", "foo", "$el", "9ab", "12", "3.5", "'s'", '"a\\"b"', "`t`", " = ", "(", ")", "+", " ", "sanitize", "a$b", "_u", "{", ";", "process.env.K"]
    lines = ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(1, 12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    got = {x.i: x.s for x in df.select("i", fixes.normal_line(F.col("t")).alias("s")).collect()}
    bad = [(lines[i], got[i], shape(lines[i])) for i in got if got[i] != shape(lines[i])]
    assert not bad, bad[:3]


def test_restored_line(spark):
    row = spark.range(1).select(fixes.restored_line(F.lit("const $VAR1 = sanitize($VAR2, $NUM, $STRING, $VAR3, $VAR4);"), F.lit('  let a = b * 4 + "q";'))).first()
    assert row[0] == '  const a = sanitize(b, 4, "q", q, _unknown_);'


def test_helpers_learn(spark):
    log = spark.sql("""SELECT 'r' repo, 'X1' code, 'false_positive' action, timestamp'2024-01-01' ts, 'cleanUp(a)' line_text
      UNION ALL SELECT 'r', 'X2', 'fixed', timestamp'2024-01-02', 'cleanUp(escape(b))' UNION ALL SELECT 'r', 'X2', 'fixed', timestamp'2024-01-03', 'escape(b)'""")
    got = {(r.function, tuple(r.codes), r.observed, r.confidence, r.source) for r in safe_helpers(log).collect()}
    assert got == {("cleanUp", ("X1",), 1, 0.5, "user_fp"), ("escape", ("X2",), 2, 0.8, "ai_fix")}


def test_learning_by_batches_equals_the_whole_log(spark):
    """Batches in any order, some late, some sent twice, one a correction, with and without merging in between."""
    r = random.Random(6)
    actions = ["detected", "fixed", "ignored", "false_positive", "verified", "fix_failed"]
    row = lambda day: (f"X{r.randrange(3)}", r.choice(actions), r.choice(["js", None]), r.choice(["/src/a", "/test/b"]), f"2024-01-{day:02d} {r.randrange(24):02d}:00:00", r.choice([None, "2024-01-01 00:00:00"]))
    schema = "code string, action string, language string, path string, ts string, detected_at string"
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumns({c: F.col(c).cast("timestamp") for c in ("ts", "detected_at")})
    store, days = LearningStore(spark, shared_folder(spark)), {d: [] for d in range(1, 6)}
    assert store.sums().count() == 0
    for batch in range(6):
        corrects = batch == 4
        rows = [row(r.choice([2, 5] if corrects else list(days))) for _ in range(15 if batch != 3 else 0)]
        assert store.add(batch, frame(rows), corrects) and not store.add(batch, frame(rows * 2))
        for d in {int(x[4][8:10]) for x in rows} if corrects else ():
            days[d] = []
        for x in rows:
            days[int(x[4][8:10])].append(x)
        if batch in (2, 5):
            store.compact()
        want = frame([x for own in days.values() for x in own])
        rowset = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
        assert rowset(merged(store.sums(), ["code"])) == rowset(rule_stats(want))
        assert rowset(language_stats_of(store.sums())) == rowset(language_stats(want))
        assert rowset(bucket_stats_of(store.sums())) == rowset(bucket_stats(want))


def test_definitions(spark, files):
    text = "function f(aa, b) {\n  const cc = aa;\n  let q = 1;\n  use(aa, cc, dd, ee);\n  var dd = 2;\n  cc = 3;\n}"
    f = findings(spark, ("a.js", 3, "X", 1, "p")).withColumn("language", F.lit("x"))
    got = {(r.name, r.kind, r.definition_line) for r in scope.definitions(f, files(("a.js", text))).collect()}
    assert got == {("aa", "parameter", 0), ("cc", "before", 1), ("dd", "after", 4)}


def test_sarif_is_complete(spark):
    f = findings(spark, ("a", 1, "X", 2, "p"), ("a", 2, "Y", 0, "q"), ("a", 3, "X", 1, "p"))
    log = json.loads(export.sarif_logs(f).first().sarif)
    run = log["runs"][0]
    assert log["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["X", "Y"]
    assert [(r["ruleIndex"], r["level"]) for r in run["results"]] == [(0, "error"), (1, "note"), (0, "warning")]


def test_a_workspace_is_one_document(spark, tmp_path):
    """Files of a repository, one after another by name, parse, however many tasks wrote them."""
    rows = [(f"src/{i % 7}.js", i, f"X{i % 5}", 2, "p\"q") for i in range(200)] + [("src/1.js", 1, "X1", 2, "p\"q")] * 2
    f = findings(spark, *rows).withColumn("repo", F.when(F.col("line") % 9 == 0, "small").otherwise("large"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name, lines in (("sarif", documents.sarif_lines(f)), ("baseline", documents.baseline_lines(suppression.build_baseline(f))), ("issues", documents.issue_lines(f, mask=False))):
            documents.write_framed(lines, str(tmp_path / name))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = lambda name, repo: json.loads("".join(p.read_text() for p in sorted((tmp_path / name / f"repo={repo}").glob("part-*"))))
    assert len(list((tmp_path / "sarif" / "repo=large").glob("part-*"))) > 1
    for repo in ("small", "large"):
        own = [r for r in f.collect() if r.repo == repo]
        run = whole("sarif", repo)["runs"][0]
        assert len(run["results"]) == len(own) and {r["ruleId"] for r in run["results"]} == {r.code for r in own}
        assert all(run["tool"]["driver"]["rules"][r["ruleIndex"]]["id"] == r["ruleId"] for r in run["results"])
        assert sum(n for codes in whole("baseline", repo)["counts"].values() for n in codes.values()) == len(own)
        assert sorted(i["pattern"] for i in whole("issues", repo)["issues"]) == sorted(r.pattern for r in own)


def test_language(spark):
    names = {"a/Dockerfile": "dockerfile", "x.TSX": "typescriptreact", "b.unknown": "unknown", ".bashrc": "", "noext": ""}
    df = spark.createDataFrame([(k,) for k in names], "p string")
    assert {r.p: r.l for r in df.select("p", language(F.col("p")).alias("l")).collect()} == names


def test_versions_in_spans_equal_a_comparison_of_all(spark):
    r = random.Random(4)
    text = lambda: ".".join(str(r.choice([0, 1, 2, 3, 10])) for _ in range(r.randint(1, 3))) + r.choice(["", "", "", "-rc1", ".post2"])
    used = sorted({(f"p{r.randrange(3)}", r.choice([text(), text(), text(), "main", "x1"])) for _ in range(120)})
    spans = [(f"p{r.randrange(4)}", f"A{i}", r.choice([None, text()]), *r.choice([(None, None), (text(), None), (None, text())])) for i in range(80)]
    lists = [(*r.choice(used), f"A{r.randrange(90)}") for _ in range(60)] + [("p0", "9.9", "A1")]
    points = spark.createDataFrame(used, "known_as string, version string").select(F.lit("e").alias("ecosystem"), "known_as", "version", version_key(F.col("version")).alias("key"))
    ends = spark.createDataFrame(spans, "known_as string, id string, low string, high string, last string")
    ends = ends.select(F.lit("e").alias("ecosystem"), "known_as", "id", *[version_key(F.col(c)).alias(c) for c in ("low", "high", "last")])
    listed = spark.createDataFrame(lists, "known_as string, version string, id string").withColumn("ecosystem", F.lit("e"))

    def inside(v, s):
        if v is None:
            return s.low is None and s.high is None and s.last is None
        return (s.low is None or s.low <= v) and (v < s.high if s.high is not None else s.last is None or v <= s.last)

    want = {(p.known_as, p.version, s.id) for p in points.collect() for s in ends.collect() if s.known_as == p.known_as and inside(p.key, s)}
    want |= {x for x in lists if x[:2] in used}
    got = [(x.known_as, x.version, x.id) for x in versions_hit(points, ends, listed).collect()]
    assert set(got) == want and len(got) == len(want) > 500


def test_a_package_with_many_versions_and_advisories(spark):
    """Ten thousand of each, of which each advisory hits three versions: the work is in proportion."""
    n = 10_000
    points = spark.range(n).select(F.lit("e").alias("ecosystem"), F.lit("p").alias("known_as"), F.concat(F.lit("1."), "id").alias("version")).withColumn("key", version_key(F.col("version")))
    ends = spark.range(n - 3).select(F.lit("e").alias("ecosystem"), F.lit("p").alias("known_as"), F.concat(F.lit("A"), "id").alias("aid"), "id")
    ends = ends.select("ecosystem", "known_as", F.col("aid").alias("id"), version_key(F.concat(F.lit("1."), F.col("id"))).alias("low"),
                       version_key(F.concat(F.lit("1."), F.col("id") + 3)).alias("high"), F.lit(None).cast("string").alias("last"))
    start = time.perf_counter()
    assert versions_hit(points, ends).count() == 3 * (n - 3)
    assert time.perf_counter() - start < 60


def test_side_tables_meet_large_ones(spark):
    """The same rows whether the side table is small enough to go to all tasks or a frequent key is dealt out."""
    large = spark.range(4000).select((F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 50)).alias("k"), F.col("id").alias("v"), F.lit(None).cast("string").alias("near"))
    side = spark.createDataFrame([(0, 10), (0, None), (7, 3), (60, 1)], "k long, line long")
    also = lambda s: s("line").isNull() | (s("line") * 100 < F.col("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        small, spread = (sorted(map(str, meet(large, side, ["k"], how, also, most_bytes=b).collect())) for b in (1 << 20, 0))
        assert small == spread and small
        assert len(small) == {"inner": 5_059, "left": 6_019, "left_semi": 3_040, "left_anti": 960}[how]
    plan = meet(large, side, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    plan = meet(large, side, ["k"], most_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan


def test_texts_stay_where_they_are(spark, files):
    """Neither changes of files nor definitions shuffle a text."""
    table = files(("a.js", "function f(a) {\n  const bb = a;\n  log(bb);\n}"), ("b.js", "x"))
    f = findings(spark, ("a.js", 2, "X", 1, "p")).withColumn("language", F.lit("x"))
    held = scope.definitions(f, table)
    assert {(r.name, r.kind, r.definition_line) for r in held.collect()} == {("bb", "before", 1)}
    dated = table.withColumn("mtime", F.lit(2))
    state = dated.select("repo", "path", F.octet_length("content").alias("size"), F.lit(1).alias("mtime"), F.when(F.col("path") == "a.js", content_hash(F.col("content"))).otherwise("old").alias("content_hash"))
    for most in (1 << 20, 0):
        changed = file_changes(dated, state, most)
        assert {(r.path, r.status) for r in changed.collect()} == {("a.js", "unchanged"), ("b.js", "modified")}
        for plan in (changed, held):
            lines = plan._jdf.queryExecution().executedPlan().toString().split("\n")
            moved = [lines[i + 1] for i, l in enumerate(lines) if "Exchange hashpartitioning" in l]
            assert not [m for m in moved if re.search(r"\b(content|lines|body)#\d+", m.split("sha2")[0])]
