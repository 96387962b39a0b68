import math
import random
import re
from collections import Counter

import numpy as np
from seclake.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "item_id long, text string, rank int, doc_id long, score long, _item long"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    big_n, big_l = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, c in docs:
            n, score = sum(c.values()), 0
            m = 100 - 75 + (75 * n * big_n) // big_l
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def asked(spark, items):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in items], SCHEMA)


def tables(seed, n=200):
    dice = random.Random(seed)
    words = [f"{w}{i}" for i in range(60) for w in ("Wörter", "x", "ÉA", "日本")]
    pick = lambda m: " ".join(words[min(int(dice.expovariate(0.08)), 239)] for _ in range(m)).replace(" ", dice.choice([" ", "-", "\n"]))
    rows = [(i, pick(dice.randrange(0, 40))) for i in range(n)] + [(None, "x0 x1"), (None, "x1"), (3, "x0"), (3, "x0"), (900, None), (901, ""), (902, "..,-"), (903, "x0 " * 30_000), (904, "X0_x1\x00x2 a'b")]
    rows += [(1000 + i, "wörter0 tie tie") for i in range(30)]
    items = [(i, pick(15)) for i in range(12)] + [(0, "tie"), (50, "x0 x0 X0"), (51, None), (52, ""), (53, "nowhere"), (50, "x0 x0 X0"), (None, "x1 wörter0"), (54, "日本1 ÉA0 a b")]
    return rows, items


def got(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_equals_brute_force(docs, spark):
    rows, items = tables(1)
    want = brute(rows, items)
    found = ranked_search.search(docs(*rows).repartition(3), asked(spark, items))
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and got(found) == want
    # Many shards; queries in blocks and an index of all terms.
    assert got(ranked_search.search(docs(*rows), asked(spark, items), shard_postings=40)) == want
    assert got(ranked_search.search(docs(*rows), asked(spark, items), block_bytes=6_000)) == want
    assert got(ranked_search.search(docs(*rows), asked(spark, items), k=3)) == brute(rows, items, 3)


def test_empty_tables(docs, spark):
    rows, items = tables(2, 5)
    assert ranked_search.search(docs(*rows).where("doc_id < 0"), asked(spark, items)).collect() == []
    assert ranked_search.search(docs(*rows), asked(spark, items).where("item_id < 0")).collect() == []


def test_reading_stops_once_all_is_resolved():
    dice = np.random.default_rng(4)
    for trial in range(200):
        n = int(dice.integers(1, 400))
        lists = []
        for _ in range(int(dice.integers(1, 8))):
            held = dice.choice(n, int(dice.integers(1, n + 1)), replace=False)
            impact = dice.integers(1, 6, len(held)) if trial % 2 else (dice.pareto(1, len(held)) * 100).astype(np.int64)
            order = np.argsort(-impact, kind="stable")
            lists.append((held[order], impact[order]))
        order = dice.permutation(n)
        top, scores, reads = ranked_search.best_of(lists, n, order, first=4)
        sums = np.zeros(n, np.int64)
        for held, impact in lists:
            sums[held] += impact
        want = sorted(((-s, o) for s, o in zip(sums.tolist(), order.tolist()) if s > 0))[:10]
        assert [(-s, order[t]) for t, s in zip(top, scores)] == want
        assert reads <= sum(len(held) for held, _ in lists)
    heavy = np.arange(100_000)
    impact = np.concatenate([np.arange(1_000_000, 999_000, -1), np.ones(99_000, np.int64)])
    _, _, reads = ranked_search.best_of([(heavy, impact), (heavy, impact)], 100_000, heavy)
    assert reads < 200


def test_index_holds_every_posting(docs, spark):
    rows, _ = tables(3, 40)
    shards = ranked_search.index(docs(*rows), shard_postings=30).collect()
    assert len(shards) > 3 and sum(r.documents for r in shards) == sum(bool(terms(t)) for _, t in rows)
    found = Counter()
    for r in shards:
        document, tf, at = np.frombuffer(r.document, "<i4"), np.frombuffer(r.tf, "<i4"), 0
        for term, size in zip(r.terms, r.sizes):
            found.update({(r.ids[d], term, int(n)): 1 for d, n in zip(document[at : at + size], tf[at : at + size])})
            at += size
    assert set(found) == {(i, t, n) for i, text in rows for t, n in Counter(terms(text)).items()}
