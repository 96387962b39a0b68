import random
from collections import Counter

import pytest
from seclake.llm import decontamination, queries

SF = "/root/testdata/sf0.001"


def tokens(text):
    return (text or "").lower().split()


def grams(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items, similarity=0.8):
    """Every window of every document against every item, without fingerprints."""
    out = {}
    for i, text in docs:
        w = tokens(text)
        vocabulary = set(w)
        for item, item_text in items:
            v = tokens(item_text)
            if not v or len(vocabulary & set(v)) < 0.5 * len(set(v)):
                continue
            k = min(5, len(v))
            want = grams(v, k)
            for start in range(max(1, len(w) - len(v) + 1)):
                have = grams(w[start : start + len(v)], k)
                union = sum((want | have).values())
                s = sum((want & have).values()) / union if union else 0
                if s >= similarity:
                    out[i, item] = max(out.get((i, item), 0), s)
    return out


@pytest.fixture
def items(spark):
    return lambda *pairs: spark.createDataFrame(list(pairs), "item_id long, text string")


def test_equals_brute_force_on_planted_windows(docs, items):
    dice = random.Random(3)
    word = lambda: "".join(dice.choices("abcdefg", k=dice.randint(2, 6)))
    benchmark = [(n, " ".join(word() for _ in range(dice.choice([3, 8, 20, 60, 90])))) for n in range(25)]
    benchmark += [(100, ""), (101, None), (102, "same same same same same same same"), (103, benchmark[4][1])]
    texts = []
    for n in range(60):
        item = dice.choice(benchmark[:25])[1].split()
        for _ in range(dice.choice([0, 0, 1, 1, 2])):
            at = dice.randrange(len(item))
            item[at : at + dice.randint(0, 1)] = [word() for _ in range(dice.randint(0, 2))]
        filler = [word() for _ in range(dice.choice([0, 5, 200]))]
        at = dice.randint(0, len(filler))
        texts.append((n, "  ".join([*filler[:at], *item, *filler[at:]]).upper()))
    texts += [(90, None), (91, ""), (92, "same " * 300), (93, texts[0][1]), (93, texts[1][1]), (94, "x " * 30_000 + benchmark[3][1])]
    got = decontamination.matches(docs(*texts), items(*benchmark)).collect()
    want = brute(texts, benchmark)
    assert len(want) > 30
    best = {}
    for r in got:
        best[r.doc_id, r.item_id] = max(best.get((r.doc_id, r.item_id), 0), r.similarity)
    assert best.keys() == want.keys()
    assert all(abs(best[k] - want[k]) < 1e-9 for k in want)


def test_spread_edits_of_long_items(docs, items):
    dice = random.Random(5)
    word = lambda: "".join(dice.choices("abcdefghij", k=dice.randint(3, 7)))
    sizes = (200, 200, 350, 600, 1000)
    benchmark = [(n, " ".join(word() for _ in range(size))) for n, size in enumerate(sizes)]
    texts = []
    for n, (_, text) in enumerate(benchmark):
        for edits, length, cut in ((2, 5, 0), (3, 3, 0), (4, 0, 3), (5, 2, 2), (8, 4, 0)):
            item = text.split()
            for at in sorted((len(item) * (e + 1) // (edits + 1) for e in range(edits)), reverse=True):
                item[at : at + cut] = [word() for _ in range(length)]
            filler = [word() for _ in range(dice.choice([0, 40]))]
            texts.append((10 * n + edits, " ".join([*filler, *item, *filler])))
    # Two 5-word insertions at the thirds of a 200-word item: similarity 0.832, and no alignment keeps 0.4 of the shingles.
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.matches(docs(*texts), items(*benchmark)).collect()}
    want = brute(texts, benchmark)
    assert {(2, 0), (12, 1)} <= got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_empty_tables(docs, items):
    some, none = docs((1, "a b c d e f")), docs((1, "x")).where("doc_id < 0")
    assert decontamination.matches(some, items((1, "x")).where("item_id < 0")).collect() == []
    assert decontamination.matches(none, items((1, "a b c d e"))).collect() == []


def test_without_leaks_keeps_columns_and_clean_rows(docs, items):
    table = docs((1, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (2, "clean"), (None, None))
    kept = decontamination.without_leaks(table, items((1, "w1 w2 w3 w4 w5 w6 w7")))
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {2, None}


def test_without_leaks_drops_rows_not_identifiers(docs, items):
    leak = "w0 w1 w2 w3 w4 w5 w6 w7 w8"
    table = docs((None, leak), (None, "clean"), (None, None), (4, leak), (4, "clean too"), (5, leak), (5, leak))
    kept = decontamination.without_leaks(table, items((1, "w1 w2 w3 w4 w5 w6 w7"))).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, "clean"), (4, "clean too")]


def test_query_finds_what_brute_force_finds(spark):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*c).collect()]
    want = brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.QUERIES["op5_decontamination"](spark, SF).collect()}
    assert got.keys() == want.keys() and want
