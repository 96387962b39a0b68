import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from seclake.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def made(n, seed=1):
    dice = random.Random(seed)
    words = {"en": ["the", "and", "of", "was", "ball", "tree"], "fr": ["le", "les", "des", "une", "arbre", "balle"]}
    rows = []
    for i in range(n):
        lang = dice.choice(["en", "fr"])
        text = dice.choices(words[lang], k=dice.randint(5, 200))
        toxic = dice.random() < 0.3
        if toxic:
            text[dice.randrange(len(text))] = dice.choice({"en": ["Idiot!", "scum"], "fr": ["crétin,", "ordure"]}[lang])
        rows.append((i, " ".join(text), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = made(1500)
    return toxicity.fitted([(t.encode(), y) for _, t, y in rows], {0: 1050, 1: 450})


def test_learns_words_in_both_languages(model):
    scorer = toxicity._Scorer(model)
    rows = made(600, seed=2)
    right = sum((scorer(t.encode()) >= 0.5) == bool(y) for _, t, y in rows)
    assert right >= 0.98 * len(rows)
    assert len(set(model.thresholds.round(6))) > 1


def test_long_texts_are_read_to_the_end(model):
    scorer = toxicity._Scorer(model)
    long = "the tree was of the ball and " * 20_000
    assert scorer(long.encode()) < 0.5 <= scorer((long + "scum").encode())
    assert scorer("unseen1 unseen2 ".encode() * 30_000) < 0.5


def test_odd_rows(spark, docs, model):
    texts = [(1, None), (2, ""), (2, " \n"), (None, "scum of the tree"), (3, "the tree")]
    got = toxicity.score(docs(*texts).coalesce(1), model).collect()
    assert [r.predicted for r in got] == [0, 0, 0, 1, 0] and len({r.score for r in got[:3]}) == 1
    assert toxicity.score(docs(*texts).where("doc_id < 0"), model).collect() == []
    kept = toxicity.without_toxic(docs(*texts), model)
    assert kept.columns == docs(*texts).columns and kept.count() == 4
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs(*texts), labels).constant == 1.0
    assert toxicity.fit(docs(*texts), labels.where("toxic is null")).constant == 0.0


def test_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op2_toxicity"](spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [(r.score, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    bad, good = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    assert (bad[:, None] > good).mean() > 0.97
    assert sum((s >= 0.5) == bool(y) for s, y in held) >= 0.96 * len(held)


def test_all_labels_are_learned_from(spark, docs):
    """Most of the words to learn, and of the texts that decide a threshold, are outside the first model's sample."""
    dice = random.Random(5)
    bad, plain = [f"slur{i}x" for i in range(60)], [f"w{i}" for i in range(200)]
    rows = []
    for i in range(2400):
        toxic = i % 3 == 0
        text = dice.choices(plain, k=12)
        text[dice.randrange(12)] = dice.choice(bad) if toxic else "calm"
        rows.append((i, " ".join(text), int(toxic)))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:1800]], "doc_id long, toxic int")
    given = docs(*[(i, t) for i, t, _ in rows])
    found = [toxicity.fit(given.repartition(parts), labels, fit_rows=20, shard_rows=600) for parts in (2, 5)]
    scorer = toxicity._Scorer(found[0])
    assert found[0].sums is None and [scorer(t.encode()) for _, t, _ in rows[:50]] == [toxicity._Scorer(found[1])(t.encode()) for _, t, _ in rows[:50]]
    known = sum(bool(toxicity._Scorer(found[0]).model.embedding[xxhash.xxh3_64_intdigest(w) % found[0].buckets].any()) for w in bad)
    right = sum((scorer(t.encode()) >= 0.5) == bool(y) for _, t, y in rows[1800:])
    assert known == 60 and right >= 590


def test_many_labels_are_met_by_a_shuffle(spark, docs):
    given, marks = docs((1, "a"), (1, "b"), (2, None), (3, "c"), (None, "d")), spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, toxic int")
    few, many = (sorted(map(tuple, toxicity.labelled(given, marks, most).select("toxic", "text").collect())) for most in (3, 2))
    assert few == many == [(0, ""), (1, "a"), (1, "b")]


def plain_score(model, text):
    """The same network with lists and loops, one place of one filter after another, in doubles."""
    marks = toxicity._MARKS
    words = [w.decode("utf-8", "replace").lower().strip(marks) for w in (text or "").encode().split()]
    table = model.embedding.astype(float)
    vectors = [sum(table[xxhash.xxh3_64_intdigest(x) % model.buckets] for x in (w, "4" + w[:4], "5" + w[:5])) for w in words]
    vectors += [np.zeros(model.size)] * max(model.widths)
    pooled = []
    for width, kernel, bias in zip(model.widths, model.kernels, model.bias):
        places = range(len(words) + 1)  # the last one is the room after the text
        for f in range(model.filters):
            best = max(sum(float(vectors[at + j] @ kernel[j, :, f].astype(float)) for j in range(width)) for at in places)
            pooled.append(max(0.0, best + float(bias[f])))
    response = sum(h * float(o) for h, o in zip(pooled, model.out)) + model.offset
    votes = [sum(w in known.split() for w in words) for known in toxicity.FUNCTION_WORDS.values()]
    language = votes.index(max(votes)) if any(votes) else len(votes)
    return 1 / (1 + math.exp(-(response - model.thresholds[language])))


def test_scores_equal_plain_loops(spark, docs, model):
    rows = [(i, t) for i, t, _ in made(40, seed=9)] + [(100, None), (101, ""), (102, "?! ..."), (103, "SCUM"), (104, "ünïcödé «scum» idiot!"), (105, "\x0bthe\x0b scum"), (None, "le la des crétin")]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    got = {r.doc_id: r.score for r in toxicity.score(docs(*rows), model).collect()}
    assert max(abs(got[i] - plain_score(model, t)) for i, t in rows) < 1e-4
