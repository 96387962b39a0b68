import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from seclake.llm import packing, queries, tokens
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
ODD = ["", None, "one", "One's don't 12 <|endoftext|> x", "Été naïve café ̈x İ ΣΣ", "a" * 300, "word***, " * 9000, "x y\x1cz\x00", "\n\t\x0b", "ﬁ é Å"]


def expected(text, capacity=4096):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
    parts = [ids[i : i + capacity] for i in range(0, len(ids), capacity)]
    return [(n, n * capacity, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for n, p in enumerate(parts)]


def check(rows, texts, capacity=4096):
    want = Counter((i, *p) for i, text in texts for p in expected(text, capacity))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_odd_texts(docs):
    texts = [*enumerate(ODD), (3, ODD[3]), (None, "no id")]
    check(packing.packed(docs(*texts)).collect(), texts)


def test_any_vocabulary(docs):
    """One that keeps white space and capitals takes no shortcut."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.cut(docs(*enumerate(ODD)), tokenizer="byte_bpe_50k.json", capacity=100_000).collect()
    want = {i: [*t.encode(text or "", add_special_tokens=False).ids, 1] for i, text in enumerate(ODD)}
    assert {r.doc_id: (r.length, r.ids_crc32) for r in rows} == {i: (len(w), zlib.crc32(struct.pack(f"<{len(w)}I", *w))) for i, w in want.items()}


def test_caches_are_bounded():
    small, large = tokens.Encoder("word_bpe_49k.json", 20_000), tokens.Encoder("word_bpe_49k.json")
    dice = random.Random(3)
    texts = [" ".join("".join(dice.choices("abcdeÉx.!", k=6)) for _ in range(400)).encode() for _ in range(20)]
    assert [small.encode(t) for t in texts] == [large.encode(t) for t in texts]
    assert small.stretches.size <= 20_000 and len(small.stretches) + len(small.stretches.old) < 200


def test_empty_table(docs, spark):
    assert packing.packed(docs((1, "x")).where("doc_id < 0")).collect() == []


def test_query_packs_close_to_the_bound(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.QUERIES["op1_packing"](spark, SF).collect()
    assert check(rows, texts) <= 1.02 * sum(r.length for r in rows) / 4096 + 1


def test_sequences_hold_the_ids(docs):
    rows = packing.packed(docs((1, "a b c"), (2, "d"), (3, None)), with_ids=True, capacity=4)
    found = packing.sequences(rows).collect()
    assert sorted(len(r.ids) for r in found) == [3, 4] and sorted(x for r in found for x in r.doc_ids) == [1, 2, 3]


def test_plans_are_whole_and_tight():
    dice = random.Random(5)
    for draw in (lambda: dice.randint(1, 4096), lambda: min(4096, int(dice.lognormvariate(6.5, 1)) + 1), lambda: dice.choice([1366, 1365, 700, 2049, 4096])):
        histogram = Counter(draw() for _ in range(20_000))
        runs = packing.plan(histogram)
        got = Counter()
        for _, bins, content in runs:
            assert sum(size * n for size, n in content) <= 4096
            for size, n in content:
                got[size] += n * bins
        assert got == histogram
        firsts = sorted((first, bins) for first, bins, _ in runs)
        assert all(a + n == b for (a, n), (b, _) in zip(firsts, firsts[1:]))
        # Best-fit decreasing, one item at a time, as the yardstick.
        rooms = Counter()
        used = 0
        for size in sorted(histogram.elements(), reverse=True):
            room = min((r for r, n in rooms.items() if n and r >= size), default=None)
            if room is None:
                used, room = used + 1, 4096
            else:
                rooms[room] -= 1
            rooms[room - size] += 1
        assert sum(n for _, n, _ in runs) <= 1.01 * used + 2
