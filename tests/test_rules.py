"""The catalogue: shape, coverage, prefilter and dialect."""

import time

import pytest
from pyspark.sql import functions as F

from seclake.functions.dialect import any_of, java_regex
from seclake.functions.literals import required
from seclake.operators.matching import scan_rules
from seclake.queries.snippets import SNIPPETS
from seclake.rules import CATEGORY_LABELS, all_rules, family, history_rules, rule, rules_in, rx
from seclake.rules.model import ADVISORY, CODE, REMINDER

# Inputs that make careless patterns slow.
HOSTILE = ["a" * 1900, "(" * 900, "{" * 900, "'" * 1900, "<" * 1900, " " * 1900, "req." * 400, "a=" * 900, "\\" * 900, "x(" * 900]


def test_size_and_shape():
    rules = all_rules()
    assert len(rules) == 289 and len({r.code for r in rules}) == 289
    assert len(CATEGORY_LABELS) == 14 and {r.category for r in rules} == set(CATEGORY_LABELS)
    for r in rules:
        assert r.match and r.message and r.suggestion and r.severity in (0, 1, 2) and r.kind in (CODE, REMINDER, ADVISORY)


def test_lookups():
    assert rule("AUTH001").category == "auth-access-control" and rule("NONE") is None
    assert {r.code for r in rules_in("cors-configuration")} == {f"CORS00{i}" for i in range(1, 7)}
    assert len(family("tokens")) == 28
    codes = {r.code for r in history_rules()}
    assert "TOKEN001" in codes and "CRED002" in codes and "CRED008" not in codes


def test_every_pattern_needs_some_text():
    assert [r.code for r in all_rules() for p in r.match if required(p) is None] == []


def test_required_text_is_in_every_match(spark):
    lines = sorted({line for _, _, text in SNIPPETS for line in text.split("\n")})
    rows = spark.createDataFrame([(line,) for line in lines], "t string").coalesce(1).cache()
    patterns = [(r.code, p) for r in all_rules() for p in r.match]
    matched = 0
    for i in range(0, len(patterns), 100):
        part = patterns[i : i + 100]
        for row in rows.select("t", *[F.col("t").rlike(java_regex(p)).alias(f"p{n}") for n, (_, p) in enumerate(part)]).collect():
            for n, (code, p) in enumerate(part):
                if row[f"p{n}"]:
                    matched += 1
                    assert any(w in row.t.lower() for w in required(p)), (code, row.t)
    assert matched > 300


def test_snippets_reach_every_rule(files):
    paths = [(f"app/{name}/Dockerfile" if extension == "Dockerfile" else f"src/{name}.{extension}", text) for name, extension, text in SNIPPETS]
    seen = {r.code for r in scan_rules(files(*paths), all_rules()).select("code").distinct().collect()}
    missing = {r.code for r in all_rules() if r.kind != ADVISORY} - seen
    assert missing <= {"CSRF008", "CSRF009", "ENC010"}


# Lines that must and must not match, for representative rules.
LINES = [
    ("AUTH001", "const token = jwt.sign(payload, 'my-invented-key');", True),
    ("AUTH001", "const token = jwt.sign(payload, process.env.JWT_SECRET);", False),
    ("CRED001", 'const password = "INVENTED_PASSWORD";', True),
    ("CRED001", 'const apiKey = "sk-0000000000000000";', True),
    ("CRED001", "const password = process.env.DB_PASSWORD;", False),
    ("DB001", '.query("SELECT * FROM users WHERE id = " + userId)', True),
    ("DB001", ".query(`SELECT * FROM users WHERE id = ${userId}`)", True),
    ("XSS001", "element.innerHTML = value;", True),
    ("XSS001", "element.outerHTML = value;", True),
    ("XSS001", "element.textContent = value;", False),
    ("CORS001", "app.use(cors())", True),
    ("CORS001", "origin: '*'", True),
    ("ENC001", "const hash = crypto.createHash('md5');", True),
    ("ENC001", "const hash = crypto.createHash('sha1');", True),
    ("FE001", "const result = eval(value);", True),
    ("API001", "app.get('/api/admin', (req, res) => {", True),
    ("FILE001", "fs.readFile(req.params.filename, 'utf-8', cb);", True),
    ("CSRF001", '<form method="post" action="/transfer">', True),
]


def test_lines(spark):
    for code, line, expected in LINES:
        assert spark.range(1).select(F.lit(line).rlike(any_of(rule(code).match))).first()[0] is expected, (code, line)


@pytest.mark.parametrize("pattern, text, expected", [
    (rx("a$"), "a", True), (rx("a$"), "a\r", False), (rx("a$"), "a\n", False), (rx("a.b"), "a\rb", False),
    (rx(r"a\sb"), "a b", True), (rx(r"\bid\b"), "éidé", True), (rx("É", "i"), "é", True), (rx("s", "i"), "ſ", False),
    (rx("[(,=:[{]x"), "[x", True), (rx("[a&&b]"), "&", True), (rx("^b", "m"), "a\nb", True), (rx(r"[^\s]x"), " x", False),
])
def test_dialect(spark, pattern, text, expected):
    assert spark.range(1).select(F.lit(text).rlike(java_regex(pattern))).first()[0] is expected


def test_hostile_lines_stay_fast(spark):
    """All patterns over lines made to be slow."""
    rows = spark.createDataFrame([(h,) for h in HOSTILE], "t string").cache()
    patterns = sorted({java_regex(p) for r in all_rules() for p in [*r.match, *r.unless, *r.unless_near]})
    rows.count()
    start = time.time()
    for i in range(0, len(patterns), 100):
        rows.select(*[F.col("t").rlike(p).alias(f"p{n}") for n, p in enumerate(patterns[i : i + 100])]).write.format("noop").mode("overwrite").save()
    assert time.time() - start < 120


def test_rules_survive_as_rows(spark):
    from seclake.rules.tables import rule_from, rule_rows, rules_of

    assert rules_of(rule_rows(spark, all_rules()).repartition(3)) == all_rules()
    own = rule_from({"code": "OWN1", "category": "api-security", "patterns": ["todo", {"pattern": r"fix\s+me", "flags": "i"}], "message": None})
    assert (own.severity, own.kind, own.message) == (1, "code-detectable", "OWN1") and len(own.match) == 2
    for bad in ({"patterns": []}, {"patterns": ["x"], "severity": 7}, {"patterns": [{"kind": "glob", "pattern": "x"}]}, {"patterns": [{"pattern": "x", "flags": "g"}]}):
        with pytest.raises(ValueError):
            rule_from({"code": "B", "category": "c"} | bad)


def test_findings_view(spark, files):
    from seclake.plans.sql import findings_view
    from seclake.rules.tables import rule_from, rule_rows

    files(("src/a.js", "// fix  me\nexec(req.body.x)"), ("src/b.py", "todo")).createOrReplaceTempView("my_files")
    rule_rows(spark, [rule_from({"code": "OWN1", "category": "api-security", "patterns": ["todo", {"pattern": r"fix\s+me"}]})]).createOrReplaceTempView("my_rules")
    findings_view(spark, "my_files", "my_findings", "my_rules")
    assert sorted(map(tuple, spark.sql("SELECT path, line, code FROM my_findings").collect())) == [("src/a.js", 0, "OWN1"), ("src/b.py", 0, "OWN1")]
    findings_view(spark, "my_files")
    assert spark.sql("SELECT count(*) FROM findings WHERE path LIKE '%.py'").first()[0] == 0
