import random
from collections import defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from seclake.llm import queries, token_counts
from seclake.llm.token_counts import CountStore
from seclake.plans.workspace import shared_folder
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "op string, seq long, doc_id long, copy long, source string, lang string, version string, n_tokens long"
CLASHING = "rows long, bucket string, batch string, live int"


class Mirror:
    """The same store as a dictionary of documents and their rows."""

    def __init__(self):
        self.rows = {}

    def apply(self, rows):
        last = {}
        for op, seq, doc, copy, source, lang, version, n in rows:
            key = (doc, copy, version)
            if seq > last.get(key, (-1,))[0]:
                last[key] = (seq, [])
            if seq == last[key][0] and op != "delete":
                last[key][1].append((source, lang, n or 0))
        for key, (_, own) in last.items():
            self.rows[key] = own

    def totals(self):
        out = defaultdict(lambda: [0, 0])
        for (_, _, version), own in self.rows.items():
            for source, lang, n in own:
                out[source, lang, version][0] += 1
                out[source, lang, version][1] += n
        return {k: tuple(v) for k, v in out.items()}


def totals(store):
    return {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in store.totals().collect()}


def test_batches_equal_a_dictionary(spark):
    dice = random.Random(8)
    store, mirror = CountStore(spark, shared_folder(spark), buckets=5), Mirror()
    assert totals(store) == {}
    for batch in range(5):
        rows = [(dice.choice(["insert", "insert", "revise", "delete"]), dice.randrange(3), dice.choice([*range(8), None]), dice.choice([1, 1, 2]), dice.choice(["a", "b", None]), dice.choice(["en", None]), dice.choice(["v1", "v2", None]), dice.choice([3, 7, None]))
                for n in range(dice.choice([0, 5, 20]) if batch else 60)]
        rows += rows[:5]
        frame = spark.createDataFrame([(*r, 9, "x", "y", 0) for r in rows], f"{SCHEMA}, {CLASHING}")
        assert store.commit(batch, frame)
        mirror.apply(rows)
        assert totals(store) == mirror.totals()
        assert not store.commit(batch, frame)
        assert totals(store) == mirror.totals()
        if batch == 2:
            store.compact()
            assert totals(store) == mirror.totals()


def test_half_written_batch_is_unseen_and_can_be_repeated(spark):
    store = CountStore(spark, shared_folder(spark))
    one = spark.createDataFrame([("insert", 0, 1, 7, "a", "en", "v", 5)], SCHEMA)
    store.commit(0, one)
    two = spark.createDataFrame([("revise", 0, 1, 7, "a", "en", "v", 9)], SCHEMA)
    spark.createDataFrame([("1", 7, "v", "zz", "zz", 99, 1, 1, 0)], token_counts._LEDGER).write.partitionBy("bucket").parquet(f"{store.folder}/ledger/part=batch-1")
    assert totals(store) == {("a", "en", "v"): (1, 5)}
    assert store.commit(1, two) and totals(store) == {("a", "en", "v"): (1, 9)}


def test_every_row_counts(docs, spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a b c"), (None, "d"), (None, "d"), (None, None), (2, "")]
    store = CountStore(spark, shared_folder(spark))
    counts = token_counts.token_counts(docs(*rows), {"words": "words"})
    store.commit(0, token_counts.changes(counts, "insert"))
    assert totals(store) == {(None, None, "words"): (7, 9)}
    store.commit(1, token_counts.changes(store.ledger().where("doc_id IS NULL"), "delete"))
    assert totals(store) == {(None, None, "words"): (4, 7)}
    assert sorted((r.doc_id, r.rows, r.n_tokens) for r in store.ledger().collect()) == [("1", 1, 3), ("1", 2, 2), ("2", 1, 0)]


def test_a_commit_reads_the_buckets_of_its_changes(spark):
    store = CountStore(spark, shared_folder(spark))
    many = spark.range(2000).select(F.lit("insert").alias("op"), F.lit(0).alias("seq"), F.col("id").alias("doc_id"), F.lit(0).alias("copy"), F.lit("s").alias("source"), F.lit("l").alias("lang"), F.lit("v").alias("version"), F.lit(1).alias("n_tokens"))
    store.commit(0, many)
    store.compact()
    one = many.where("doc_id = 77")
    bucket = store._entries(one, 1).first().bucket
    held = store._read("ledger", token_counts._LEDGER, 0, [0]).where(F.col("bucket").isin([bucket]))
    files = {r.f for r in held.select(F.input_file_name().alias("f")).distinct().collect()}
    assert files and all(f"bucket={bucket}/" in f for f in files) and held.count() < 200
    assert store.commit(1, one.withColumn("n_tokens", F.lit(5))) and totals(store) == {("s", "l", "v"): (2000, 2004)}
    assert totals(CountStore(spark, store.folder)) == {("s", "l", "v"): (2000, 2004)}


def test_counts(docs):
    rows = [(1, None), (2, ""), (3, "Two words"), (3, "again"), (4, "it's " * 20_000), (None, "x")]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_counts.token_counts(docs(*rows), {"bpe": "word_bpe_49k.json", "words": "words"}).collect()
    want = [(i, v, n) for i, x in rows for v, n in (("bpe", len(t.encode(x or "", add_special_tokens=False).ids)), ("words", len((x or "").split())))]
    assert sorted(((r.doc_id, r.version, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(docs(*rows).where("doc_id < 0"), {"words": "words"}).collect() == []


def test_query(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    want = defaultdict(lambda: [0, 0])
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        label = labels.get(d.doc_id)
        if label and label.toxic == 1:
            continue
        words, ids = len(d.text.split()), len(t.encode(d.text, add_special_tokens=False).ids)
        for version, n in (("bpe", ids + 1 if label and label.quality == 0 else ids), ("words", words)):
            want[d.source, d.lang, version][0] += 1
            want[d.source, d.lang, version][1] += n
    got = {(r.source, r.lang, r.version): [r.documents, r.tokens] for r in queries.QUERIES["op10_token_counts"](spark, SF).collect()}
    assert got == want
