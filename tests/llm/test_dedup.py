import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from seclake.llm import exact_dedup, line_dedup, queries

TEXTS = ["Same Text", "same text", None, "", "É x", "é x", "SAME TEXT", "long " * 20_000, "x\n", "x"]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_groups(docs):
    rows = [*enumerate(TEXTS), (3, ""), (1, "same text"), (None, "lost"), (None, "x")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    want = Counter()
    for i, t in rows:
        ids = [x for x in groups[lowered(t)] if x is not None]
        keep = max(ids, default=None)
        want[(i, keep, len(groups[lowered(t)]), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest())] += 1
    got = exact_dedup.exact_groups(docs(*rows))
    assert Counter(map(tuple, got.collect())) == want
    assert exact_dedup.exact_groups(docs(*rows).where("doc_id < -1")).collect() == []


def test_exact_groups_can_keep_the_smallest_in_any_number_of_runs(docs):
    rows = [(i, f"t{i % 7}") for i in range(100)]
    for runs, fan_in in ((1, 2), (5, 2), (64, 8)):
        got = exact_dedup.exact_groups(docs(*rows), keep="min", runs=runs, fan_in=fan_in).collect()
        assert {(r.doc_id, r.keep_id) for r in got} == {(i, i % 7) for i in range(100)}


def test_without_copies_keeps_all_columns(docs):
    table = docs(*enumerate(TEXTS))
    kept = exact_dedup.without_copies(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, 8, 9}


def test_without_copies_drops_rows_not_identifiers(docs):
    rows = [(None, "A"), (None, "B"), (7, "B"), (8, "C"), (8, "D"), (9, "d"), (5, "E"), (5, "E"), (5, "e"), (None, "F"), (None, "F"), (None, None), (None, "")]
    for keep, d_id in (("max", 9), ("min", 8)):
        kept = sorted((lowered(r.text), r.doc_id) for r in exact_dedup.without_copies(docs(*rows), keep=keep).collect())
        assert kept == [("", None), ("a", None), ("b", 7), ("c", 8), ("d", d_id), ("e", 5), ("f", None)]


def expected_lines(rows, minimum, threshold):
    key = lambda line: lowered(line.strip(" \t\n\x0b\f\r"))
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(key(x)) < minimum or seen[key(x)] < threshold]
        out[(i, len(lines), len(lines) - len(left), "\n".join(left))] += 1
    return out


def test_kept_lines(docs):
    rows = [(i, f"Shared line \n\n own {i}\r\n\t SHARED LINE\nÉ{'' if i % 2 else ' '}") for i in range(12)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "shared line"), (54, "one\n" * 5000 + "shared line\n"), (54, "twin"), (None, "shared line\nx"), (3, rows[3][1])]
    got = line_dedup.kept_lines(docs(*rows), min_documents=10)
    assert Counter(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "text").collect())) == expected_lines(rows, 1, 10)
    got = line_dedup.kept_lines(docs(*rows), min_length=5, min_documents=2)
    assert Counter(map(tuple, got.collect())) == expected_lines(rows, 5, 2)
    assert line_dedup.kept_lines(docs(*rows).where(F.lit(False))).collect() == []


def test_kept_lines_by_id(spark, docs, tmp_path):
    rows = [(1, "tenfold\nmixed")] * 10 + [(2, f"own {i}\nversions") for i in range(10)] + [(i, "spread") for i in range(10, 20)] + [(None, f"lost {i}\nnowhere\nspread") for i in range(10)]
    docs(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op9_line_dedup"](spark, str(tmp_path))
    dropped = Counter((r.doc_id, r.n_dropped) for r in got.collect())
    assert dropped == Counter([(1, 0)] * 10 + [(2, 0)] * 10 + [(i, 1) for i in range(10, 20)] + [(None, 1)] * 10)
