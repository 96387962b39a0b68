"""What grows with a table: tasks, batches, steps on a long line, and what moves between tasks."""

import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seclake.functions.dialect import java_regex, linear_guard
from seclake.functions.prefilter import _slices
from seclake.operators import insights, suppression
from seclake.operators.matching import line_findings, pattern_table, pick_reminders, possible_pairs, scan_rules
from seclake.plans import scan as scans
from seclake.plans.scan import editor_scan, findings_with_confidence, scan
from seclake.queries import corpus, inputs
from seclake.queries.snippets import SNIPPETS
from seclake.rules import all_rules
from seclake.rules.model import ADVISORY, Rx
from seclake.sources import files as files_module
from seclake.sources.files import read_files, spread, write_files


def test_long_lines_take_linear_time(spark, files):
    many = files(("src/a.js", 'href="x" redirect("y" ' * 30_000), ("src/b.js", 'redirect("y" + req.query.x'))
    rules = [r for r in all_rules() if r.code == "XSS011"]
    began = time.time()
    assert {r.path for r in scan_rules(many, rules).collect()} == {"src/b.js"}
    assert time.time() - began < 30


@pytest.mark.parametrize("text, guard", [
    ("a.*b", r"\A(?>(?s:.*?)(?=a))(?>(?s:.*?)(?=b))"), ("a|b.*c", None), ("(a).*\\1", None), ("a(b.*c)", None), ("a[.*]b", None), ("a\\.*b", None),
])
def test_guards(text, guard):
    assert linear_guard(Rx(text, "")) == guard


def test_guards_let_every_match_pass(spark):
    lines = spark.createDataFrame([(line,) for _, _, text in SNIPPETS for line in text.split("\n")], "text string").coalesce(1).cache()
    kept = [(p, linear_guard(p)) for r in all_rules() for p in r.match if linear_guard(p)]
    lost = [F.count(F.when(F.rlike("text", F.lit(java_regex(p))) & ~F.rlike("text", F.lit(g)), 1)) for p, g in kept]
    met = [F.count(F.when(F.rlike("text", F.lit(java_regex(p))), 1)) for p, _ in kept]
    assert sum(lines.agg(*lost).first()) == 0 and sum(lines.agg(*met).first()) > 10


def test_batches_are_read_in_parts():
    batch = pd.Series(["x" * 10, None, "y" * 95, "z", "", "w" * 5])
    parts = list(_slices(batch, 100, 3))
    assert [len(p) for p in parts] == [3, 3] and pd.concat(parts).equals(batch)
    assert [len(p) for p in _slices(batch, 1, 3)] == [1, 2, 1, 2] and not list(_slices(batch[:0]))


def test_spread_deals_large_texts(spark):
    table = spark.range(640, numPartitions=8).select(F.repeat(F.lit("x"), 1000).alias("text"))
    dealt = spread(table, 10_000)
    assert dealt.rdd.getNumPartitions() == 64 and dealt.count() == 640
    assert spread(table, 80_000).rdd.getNumPartitions() == 8


def test_no_line_is_moved(spark, files):
    helpers = [("r", "escapeHtml", ["XSS"], 5, 0.9), ("r", "absent", ["CORS"], 5, 0.9), ("q", "password", ["CRED"], 5, 0.9)]
    safe = spark.createDataFrame(helpers, "repo string, function string, codes array<string>, observed int, confidence double")
    rows = files(*[(f"src/{i}.{ext}", text + "\n// escapeHtml") for i, (_, ext, text) in enumerate(SNIPPETS)])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    carried = re.compile(r"min\(struct\([^()]*\bnear, near#")
    assert carried.search(plan(line_findings(rows, all_rules(), keep_near=True)))
    assert not carried.search(plan(findings_with_confidence(rows))) and not carried.search(plan(editor_scan(rows, safe=safe)))
    key = ["path", "code", "line", "pattern"]
    told = lambda df: sorted(tuple(r[c] for c in key) for r in df.collect())
    rules = all_rules()
    late = suppression.learned_suppression(pick_reminders(line_findings(rows, rules, keep_near=True)), safe)
    judge = lambda hits: suppression.helpers_nearby(hits, safe, [r.code for r in rules])
    early = suppression.learned_suppression(pick_reminders(line_findings(rows, rules, keep_near=True, judge=judge)))
    assert told(late) == told(early) and 0 < len(told(early)) < len(told(scan_rules(rows, rules)))


def test_lines_around_go_with_the_pairs_that_need_them(spark, files, monkeypatch):
    """They are copied into each pair and sorted with it: seven lines for each pattern that a line could match, if every rule had them."""
    joined = "\nconst sql = 'select ' + id;\n"
    rows = files(*[(f"src/{i}.{ext}", (joined + text.replace("\n", joined + "\n")) * (i % 2 + 1)) for i, (_, ext, text) in enumerate(SNIPPETS)])
    rules, asked = [r for r in all_rules() if r.kind != ADVISORY], []
    monkeypatch.setattr(scans, "line_findings", lambda f, r, near, *a, **k: asked.append(near) or line_findings(f, r, near, *a, **k))
    told = lambda: sorted(str(tuple(r)) for r in findings_with_confidence(rows).select("path", "line", "code", "pattern", "confidence").collect())
    few = told()
    owner = [r for r in rules for _ in r.match]
    held = {owner[r.number].code for r in possible_pairs(rows, rules, asked[0]).where("near IS NOT NULL").select("number").distinct().collect()}
    need = {r.code for r in rules if r.unless_near or r.code.startswith(("SQL", "DB001", "DB002"))}
    assert held and held <= need < {r.code for r in rules}
    monkeypatch.setattr(scans, "QUERY_CODES", True)
    assert told() == few
    monkeypatch.setattr(scans, "QUERY_CODES", False)
    assert told() != few and asked[1:] == [True, False]


def test_few_rows_start_no_python_worker_and_what_a_number_tells_is_not_moved(spark, files):
    rows = files(*[(f"src/{i}.{ext}", text) for i, (_, ext, text) in enumerate(SNIPPETS)])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan(pattern_table(spark, all_rules())) and "ExistingRDD" not in plan(pattern_table(spark, all_rules()))
    assert "ExistingRDD" not in plan(corpus.code_from(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    moved = re.findall(r"min\(struct\(([^()]*)\)", plan(scan(rows)))
    assert moved and not any("message" in m or "suggestion" in m for m in moved)


def test_the_fix_log_is_dealt_over_the_cores(spark):
    """One small file of events is one split; the shapes of its lines are made by several tasks all the same."""
    assert spark.read.parquet("/root/testdata/sf0.01/events.parquet").rdd.getNumPartitions() == 1
    assert inputs.fix_log(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() > 1


def test_regressions_are_summed_from_a_stored_table(spark):
    """What finds them may be whole scans, which are not to run once for the totals and once for the sample."""
    found = spark.createDataFrame([("r", f"p{i % 5}", "A", i, i == 7) for i in range(20)], "repo string, path string, code string, line int, acknowledged boolean")
    told = insights.regression_summary(found)
    assert tuple(told.first()) == ("r", 19, 5, "p0, p1, p2")
    assert "acknowledged" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_stored_some_to_a_folder(spark, tmp_path):
    rows = [(f"doc={i}.txt", None if i == 3 else f"x{i}\n") for i in [*range(25), 7]]
    place = str(tmp_path / "files")
    assert write_files(spark.createDataFrame(rows, "name string, content string").coalesce(1), place, 10) == 26
    got = sorted((r.path, r.content) for r in read_files(spark, place, "r", includes=["part-"]).collect())
    # Spark's readers leave out files without a byte.
    assert got == sorted((f"part-000000-{i // 10:06d}/{i}-{n}", c) for i, (n, c) in enumerate(rows) if c)


def _tree(place):
    for i, name in enumerate([
        "a.py", "src/b c+d%20é.js", "src/deep/er/e.ts", "node_modules/f.js", ".hidden/g.js", "src/.h.js", "_i/j.js", "_k=1/l.js", "src/_m.py", "src/_n=2.py", "docs/o.md", "src/empty.js",
    ]):
        (place / name).parent.mkdir(parents=True, exist_ok=True)
        (place / name).write_bytes(b"" if "empty" in name else b"caf\xe9 \n" * (i + 1))
    (place / "src/linked.js").symlink_to(place / "a.py")
    (place / "linked").symlink_to(place / "src/deep")
    (place / "src/broken.js").symlink_to(place / "nowhere.js")


def test_tasks_list_and_read_what_sparks_reader_does(spark, tmp_path, monkeypatch):
    place = tmp_path / "tree"
    place.mkdir()
    _tree(place)
    found = lambda root, **options: sorted(map(tuple, read_files(spark, root, "r", includes=["docs/"], **options).collect()))
    roots = [str(place), f"file://{place}/", f"file:{place}"]
    own = [found(r) for r in roots] + [found(roots[0], max_size=20)]
    plan = read_files(spark, roots[0], "r")._jdf.queryExecution().executedPlan().toString()
    # The driver holds no list of the files: they come from a stored table.
    assert "binaryFile" not in plan and "ArrowEvalPython" in plan
    assert "ArrowEvalPython" not in read_files(spark, roots[0], "r").select("path", "size", "mtime")._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(files_module, "_local_folder", lambda spark, root: None)
    assert own == [found(r) for r in roots] + [found(roots[0], max_size=20)]
    assert {r[1] for r in own[0]} == {"a.py", "src/b c+d%20é.js", "src/deep/er/e.ts", "_k=1/l.js", "src/_n=2.py", "docs/o.md", "src/linked.js", "linked/er/e.ts"}


def test_many_files_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    rows = [(f"{i}.py", "x" * 100) for i in range(3000)]
    place = str(tmp_path / "many")
    write_files(spark.createDataFrame(rows, "name string, content string").coalesce(2), place, 100)
    most = 4 * spark.sparkContext.defaultParallelism
    assert read_files(spark, place, "r").count() == 3000 and read_files(spark, place, "r").rdd.getNumPartitions() <= most
    monkeypatch.setattr(files_module, "_local_folder", lambda spark, root: None)
    assert read_files(spark, place, "r").count() == 3000 and read_files(spark, place, "r").rdd.getNumPartitions() <= most
