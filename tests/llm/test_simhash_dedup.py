import random
import re
from collections import Counter

import numpy as np
import xxhash
from seclake.llm import queries, simhash_dedup

SF = "/root/testdata/sf0.001"


def mark(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    marks = [mark(t) for _, t in rows]
    part = list(range(len(rows)))
    def root(i):
        while part[i] != i:
            i = part[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                part[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        ids = [x for x in (smallest.get(root(i)), doc) if x is not None]
        smallest[root(i)] = min(ids, default=None)
    return Counter((doc, f"{marks[i]:016x}", smallest[root(i)]) for i, (doc, _) in enumerate(rows))


def got(df):
    return Counter(map(tuple, df.collect()))


def texts():
    dice = random.Random(2)
    words = ["".join(dice.choices("abcdeé", k=4)) for _ in range(300)]
    base = [" ".join(dice.choices(words, k=n)) for n in (5, 60, 400, 900)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One two"), (6, "one  TWO"), (7, "x" * 40_000), (8, "É É é é é"), (None, base[0]), (9, base[0]), (9, base[1])]
    for n in range(60):
        w = base[n % 4].split()
        for _ in range(n % 3):
            w[dice.randrange(len(w))] = dice.choice(words)
        rows.append((100 - n, " ".join(w)))
    return rows


def test_equals_brute_force(docs):
    rows = texts()
    want = brute(rows)
    assert len({c for _, _, c in want}) < len({m for _, m, _ in want})
    assert got(simhash_dedup.near_duplicates(docs(*rows))) == want
    assert got(simhash_dedup.near_duplicates(docs(*rows), group_rows=5, agree=2)) == want
    assert simhash_dedup.near_duplicates(docs(*rows).where("doc_id < 0")).collect() == []


def test_tiles_link_all_that_are_near():
    dice = np.random.default_rng(1)
    for size in (2, 50, 700):
        marks = dice.integers(0, 2**63, size // 2, dtype=np.uint64)
        marks = np.unique(np.concatenate([marks, marks ^ (np.uint64(1) << dice.integers(0, 64, len(marks), dtype=np.uint64)), marks ^ np.uint64(0b1111100000)]))
        first = simhash_dedup.tiled_links(marks, 4, tile=16)
        part = list(range(len(marks)))
        def root(i):
            while part[i] != i:
                i = part[i]
            return i
        for i in range(len(marks)):
            for j in range(i):
                if int(marks[i] ^ marks[j]).bit_count() <= 4:
                    part[root(i)] = root(j)
        groups = [root(i) for i in range(len(marks))]
        assert len(set(zip(first, groups))) == len(set(groups)) == len(set(first))


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 400)] + [(1000, 1001)], "a long, b long")
    assert {(r.mark, r.root) for r in simhash_dedup.components(edges).collect()} == {(i, 0) for i in range(401)} | {(1000, 1000), (1001, 1000)}


def test_one_of_each_keeps_columns(docs):
    table = docs((5, "a b c d e"), (3, "A b c d e"), (4, "entirely different words here now"))
    kept = simhash_dedup.one_of_each(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {3, 4}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.QUERIES["op8_simhash_dedup"](spark, SF)) == brute(rows)


def test_one_of_each_drops_rows_not_identifiers(docs):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (7, b), (8, c), (8, d), (9, d.upper()), (8, a.upper()), (3, c), (3, c), (3, c.upper()), (None, ""), (None, None)]
    kept = sorted(((r.text or "").lower()[:1], r.doc_id or 0) for r in simhash_dedup.one_of_each(docs(*rows)).collect())
    assert kept == [("", 0), ("a", 8), ("b", 7), ("c", 3), ("d", 8)]
