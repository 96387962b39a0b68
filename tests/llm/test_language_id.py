import math
import re
import zlib
from collections import Counter

import pytest
from seclake.llm import language_id, queries
from seclake.llm.language_id import LanguageModel

SF = "/root/testdata/sf0.01"


def test_backs_off_from_words_to_letters():
    from collections import Counter

    model = LanguageModel({"a": Counter({"hello": 9, "help": 5, "rare": 1}), "b": Counter({"bonjour": 9, "jour": 4})}, min_count=3)
    assert set(model.words) == {"hello", "help", "bonjour", "jour"}
    assert model.word("hello") == model.words["hello"]
    assert model.word("hellx")[0] > model.word("hellx")[1]
    assert model.word("xxjourx")[1] > model.word("xxjourx")[0]
    assert set(model.word("ζ")) == {0}


def test_odd_texts(spark, docs):
    rows = [(1, "the cat sat", "en"), (2, "le chat est", "fr"), (3, None, "en"), (4, "x", None), (5, "the " * 50, "en"), (6, "le " * 50, "fr")]
    train = spark.createDataFrame([(i, t, l, "z") for i, t, l in rows], "doc_id long, text string, lang string, score string")
    model = language_id.fit(train, min_count=1)
    assert model.languages == ["en", "fr"]
    texts = [(1, None), (2, ""), (3, "12 345 --- _ ½"), (4, "THE"), (5, "le,le;LE"), (6, "the " * 60_000), (6, "le"), (None, "Ω"), (7, "Ⅷ x")]
    got = {(r.doc_id, t): (r.lang_pred, r.score) for r, (_, t) in zip(language_id.identify(docs(*texts).coalesce(1), model).collect(), texts)}
    assert [got[k][0] for k in texts[:7]] == ["und", "und", "und", "en", "fr", "en", "fr"] and got[None, "Ω"][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())
    empty = language_id.fit(train.where("doc_id < 0"))
    assert {r.lang_pred for r in language_id.identify(docs(*texts), empty).collect()} == {"und"}
    assert language_id.identify(docs(*texts).where("doc_id < 0"), model).collect() == []


@pytest.fixture(scope="module")
def predicted(spark):
    return queries.QUERIES["op6_language_id"](spark, SF).collect()


def test_held_out_accuracy(spark, predicted):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert {r.doc_id for r in predicted} == set(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in predicted)
    held = [r for r in predicted if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def plain(train, text, longest=5, least=3, smooth=0.5):
    """Language and score by dictionaries and loops, the model included."""
    letters = re.compile(r"[^\W\d_]+")
    languages = sorted({l for _, l in train if l})
    counts = {l: Counter(w for t, m in train if m == l and t for w in letters.findall(t.lower())) for l in languages}
    pieces = lambda w, n: [w[i : i + n] for i in range(len(w))] if n == 1 else [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    tables = [{l: Counter({w: n for w, n in counts[l].items() if n >= least}) for l in languages}]
    for n in range(1, longest + 1):
        grams = {l: Counter(g for w in counts[l] for g in pieces(w, n)) for l in languages}
        tables.append({l: Counter({g: k for g, k in grams[l].items() if n == 1 or k >= least}) for l in languages})

    def logs(table, entry):
        entries = set().union(*table.values())
        return [math.log((table[l][entry] + smooth) / sum(table[l][e] + smooth for e in entries)) for l in languages]

    def word(w):
        if any(w in c for c in tables[0].values()):
            return logs(tables[0], w)
        for n in range(min(longest, len(w) + 2), 0, -1):
            known = [logs(tables[n], g) for g in pieces(w, n) if any(g in c for c in tables[n].values())]
            if known:
                return [sum(x) / len(known) for x in zip(*known)]
        return [0.0] * len(languages)

    found = letters.findall((text or "").lower())
    if not found and not any(c.isalpha() for c in text or "") or not languages:
        return "und", 0.0
    totals = [sum(x) for x in zip(*map(word, found))] if found else [0.0] * len(languages)
    likely = [t / max(1, len(found)) * min(len(found), 20) for t in totals]
    odds = [math.exp(x - max(likely)) for x in likely]
    return languages[odds.index(max(odds))], max(odds) / sum(odds)


def test_equals_dictionaries_and_loops(spark, docs):
    own = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    train = [(t[:600], l) for t, l in own[:60]]
    model = language_id.fit(spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(train)], "doc_id long, text string, lang string"))
    rows = [(i, t[:400]) for i, (t, _) in enumerate(own[60:75])] + [(100, None), (101, "4711 --"), (102, "Straße ÜBER qzx"), (103, "a"), (104, "ζζζ the"), (None, "l'été d'avant")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs(*rows), model).collect()}
    for i, t in rows:
        lang, score = plain(train, t)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4
