"""What moves to the keyed state of a stream of versions: one row a version, with the hits that count."""

import itertools
import random
import re

import pyarrow as pa
import pytest

from seclake.functions.prefilter import _searcher
from seclake.queries import QUERIES, inputs
from seclake.queries.outputs import _stream
from seclake.streaming.versions import one_row_each, updates

SCANNED = pa.schema([
    ("repo", pa.string()), ("path", pa.string()), ("language", pa.string()), ("ts", pa.int64()), ("content_hash", pa.string()), ("line", pa.int32()), ("col", pa.int32()),
    ("code", pa.string()), ("severity", pa.int32()), ("pattern", pa.string()), ("number", pa.int32()), ("told", pa.string()), ("reminds", pa.int32()), ("score", pa.int32()),
])


def expected(hits, limit):
    first = {}
    for h in hits:
        key = (h["line"], h["code"], h["told"])
        if key not in first or h["number"] < first[key]["number"]:
            first[key] = h
    out, reminders = [], {}
    for h in sorted(first.values(), key=lambda h: (h["line"], h["number"])):
        if h["reminds"]:
            reminders.setdefault(h["code"], []).append(h)
        else:
            out.append(h)
    out += [max(own if limit is None else own[:limit], key=lambda h: (h["score"], -h["line"])) for own in reminders.values()]
    return sorted((h["line"], h["number"], h["told"] or "") for h in out)


@pytest.mark.parametrize("limit", [None, 2])
def test_versions_become_rows_wherever_batches_end(limit):
    draw, rows, wanted = random.Random(7), [], []
    for i in range(200):
        version = {"repo": "r", "path": None if i == 5 else f"p{i % 9}", "language": "x", "ts": i, "content_hash": f"h{i}"}
        hits = [
            {"line": draw.randrange(6), "col": 1, "code": f"C{n // 3}", "severity": 1, "pattern": f"m{n}", "number": n, "told": draw.choice(["a", "b"]) if n > 8 else None, "reminds": int(n < 3), "score": draw.randrange(3) if n < 3 else 0}
            for n in (draw.randrange(12) for _ in range(0 if i % 7 == 0 else draw.randrange(30)))
        ]
        # How well a line reminds is told by the line.
        for h in hits:
            h["score"] = (h["line"] * 7) % 3 if h["reminds"] else 0
        rows += [version | {"line": None, "code": None, "number": -1, "reminds": 0, "score": 0}, *(version | h for h in hits)]
        wanted.append((version["path"], i, expected(hits, limit)))
    table = pa.Table.from_pylist(rows, SCANNED)
    for size in (1, 7, 100, len(rows)):
        batches = [b for k in range(0, len(rows), size) for b in table.slice(k, size).to_batches()]
        got = list(itertools.chain.from_iterable(b.to_pylist() for b in one_row_each(limit)(iter(batches))))
        assert [(r["path"], r["ts"], sorted((h["line"], h["number"], h["told"] or "") for h in r["found"])) for r in got] == wanted
    assert not list(one_row_each(limit)(iter([])))


def test_state_is_called_once_a_bucket(spark, tmp_path):
    rows = [("r", f"src/{i}.js", "javascript", f"key_id = 'AKIAABCDEFGHIJKLMNO{i % 10}'\n" * 5, t) for i in range(40) for t in (1, 2)]
    schema = "repo string, path string, language string, content string, ts long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = updates(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), buckets=4)
    query = stream.writeStream.outputMode("update").format("memory").queryName("bucketed").start()
    try:
        query.processAllAvailable()
        state = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
        got = spark.table("bucketed").where("code IS NULL").collect()
    finally:
        query.stop()
    assert sum(s["numRowsUpdated"] for s in state) <= 4
    # Contents are the same in both versions; only one of each path is told.
    assert sorted(r.path for r in got) == sorted(f"src/{i}.js" for i in range(40))


def test_files_are_scanned_once_for_old_findings_and_statuses(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "tables")
    rows = [(i, f"key = 'AKIAABCDEFGHIJKLMNO{i % 10}'", "en", "src", 5) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    wanted = sorted(map(tuple, QUERIES["str03_verify_stream"](spark, place).collect()), key=str)

    def again(*_):
        raise AssertionError("scanned again")

    monkeypatch.setattr(inputs, "findings", again)
    assert sorted(map(tuple, QUERIES["str03_verify_stream"](spark, place).collect()), key=str) == wanted != []


def test_patterns_of_the_table_are_not_compiled_for_each_row(spark, files):
    from seclake.operators.matching import pattern_hits
    from seclake.rules import all_rules

    plan = pattern_hits(files(("src/a.js", "x")), all_rules())._jdf.queryExecution().optimizedPlan().toString()
    of_table = r"(?:only_paths|skip_paths|info_paths|guard|regex|unless|unless_near)#"
    assert re.search(rf"regexp_instr\([^()]*, {of_table}", plan) and not re.findall(rf"RLIKE\([^()]*, {of_table}", plan)


def test_candidates_come_by_pattern_where_asked():
    words, free = {"aa": [0 << 2, 2 << 2], "b": [1 << 2 | 3]}, [3 << 2]
    text = "b aa\nx\naa b"
    by_line = _searcher(words, free)(text)
    by_pattern = _searcher(words, free, 2)(text)
    numbers = lambda marks: [(m >> 20, m >> 2 & 7) for m in marks]
    assert by_line == sorted(by_pattern)
    # Numbers 0 and 1 by pattern, those from 2 on by line.
    assert numbers(by_pattern) == [(0, 0), (2, 0), (0, 1), (2, 1), (0, 2), (0, 3), (1, 3), (2, 2), (2, 3)]


def test_a_table_of_one_file_is_streamed_by_several_tasks(spark, tmp_path):
    place = str(tmp_path / "one")
    spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string").coalesce(1).write.parquet(f"{place}/documents.parquet")
    got = []
    stream = _stream(spark, place, "documents").writeStream.foreachBatch(lambda df, n: got.append((df.rdd.getNumPartitions(), df.count())))
    stream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [n for _, n in got] == [50] and got[0][0] >= spark.sparkContext.defaultParallelism
