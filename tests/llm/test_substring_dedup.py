import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from seclake.llm import queries, substring_dedup
from seclake.llm.fm_index import FmIndex, WaveletTree

SF = "/root/testdata/sf0.001"


def brute(rows, length=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    smallest = {}
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            smallest[key] = min(smallest.get(key, float("inf")), float("inf") if i is None else i)
    out = Counter()
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - length + 1):
            if smallest[tuple(w[p : p + length])] < (float("inf") if i is None else i):
                gone.update(range(p, p + length))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def got(df):
    return Counter(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))


def test_wavelet_ranks():
    values = np.random.default_rng(1).integers(0, 300, 5000)
    tree = WaveletTree(values, 299)
    for v in (0, 1, 128, 255, 299):
        at = np.arange(0, 5001, 17)
        assert (tree.rank(np.full(len(at), v), at) == [np.sum(values[:p] == v) for p in at]).all()


def test_backward_search_counts_occurrences():
    text = np.append(np.random.default_rng(2).integers(1, 4, 400), 0)
    index = FmIndex(text, 5)
    ends = np.arange(4, 400)
    low, high = index.search(ends, text, 5)
    seen = Counter(tuple(text[p : p + 5]) for p in range(396))
    assert [h - l for l, h in zip(low, high)] == [seen[tuple(text[e - 4 : e + 1])] for e in ends]
    assert all(tuple(text[index.order[l] : index.order[l] + 5]) == tuple(text[e - 4 : e + 1]) for e, l in zip(ends, low))


def texts():
    dice = random.Random(4)
    word = lambda: dice.choice(["a", "b", "the", "of", "É"]) if dice.random() < 0.3 else "".join(dice.choices("abcdef", k=5))
    passages = [[word() for _ in range(n)] for n in (12, 13, 14, 40, 200)]
    rows = []
    for n in range(80):
        w = [word() for _ in range(dice.choice([0, 5, 30, 300]))]
        for _ in range(dice.choice([0, 1, 2, 3])):
            at = dice.randint(0, len(w))
            w[at:at] = dice.choice(passages)
        rows.append((dice.randint(0, 1000), dice.choice([" ", "\n", " \t\x0b"]).join(w)))
    return rows + [(5, None), (6, ""), (7, "\n "), (8, "a " * 3000), (3, "a " * 14), (9, "A " * 20), (None, rows[3][1]), (None, rows[3][1]), (rows[5][0], rows[5][1]), (rows[5][0], rows[6][1]), (2000, " ".join(passages[4] * 30)), (1999, "x\x1cy " * 20)]


def test_equals_brute_force(docs):
    rows = texts()
    want = brute(rows)
    assert sum(c[2] for c in want) > 500
    assert got(substring_dedup.without_repeats(docs(*rows))) == want
    assert got(substring_dedup.without_repeats(docs(*rows).repartition(13), task_words=500)) == want
    assert got(substring_dedup.without_repeats(docs(*rows), length=5)) == brute(rows, 5)
    assert substring_dedup.without_repeats(docs(*rows).where("doc_id < 0")).collect() == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.QUERIES["op4_substring_dedup"](spark, SF)) == brute(rows)


def test_equal_rows_do_not_multiply(spark):
    """Sixteen thousand rows without identifier and of one text, most of which repeats a smaller document's."""
    passage = " ".join(f"w{i}" for i in range(40))
    one = spark.createDataFrame([(1, "a b " + passage)], "doc_id long, text string")
    many = spark.range(16_000, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit(passage + " c d").alias("text"))
    start = time.perf_counter()
    rows = substring_dedup.without_repeats(one.unionByName(many), with_text=False).collect()
    assert time.perf_counter() - start < 30
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in rows) == {(1, 42, 0): 1, (None, 42, 40): 16_000}
