"""Each stage of the pipeline against brute force on what the stage before it kept."""

import corpus_pipeline
import test_decontamination
import test_dedup
import test_packing
import test_simhash_dedup
from seclake.llm import toxicity
from seclake.plans.workspace import written

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Copies, near copies and a leak on top of what the table holds.
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    base = docs.orderBy("doc_id").first()
    more = [(9001, base.text.upper()), (9002, base.text + " more"), (9003, f"some words before {item} and after"), (9004, None), (9005, "")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in more], docs.schema))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    stages = dict(corpus_pipeline.STAGES)

    out = written(stages["toxicity"](spark, docs, SF))
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert out.columns == COLUMNS and sorted(rows(out), key=str) == sorted((r for r in rows(docs) if r[0] not in bad), key=str)

    docs, out = out, written(stages["exact dedup"](spark, out, SF))
    last = {}
    for i, t in rows(docs):
        key = test_dedup.lowered(t)
        last[key] = max(i, last.get(key, i))
    assert out.columns == COLUMNS and {i for i, _ in rows(out)} == set(last.values())

    docs, out = out, written(stages["SimHash near-dedup"](spark, out, SF))
    assert out.columns == COLUMNS and {i for i, _ in rows(out)} == {c for _, _, c in test_simhash_dedup.brute(rows(docs))}

    docs, out = out, written(stages["benchmark decontamination"](spark, out, SF))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, _ in test_decontamination.brute(rows(docs), items)}
    assert 9003 in leaks and out.columns == COLUMNS and {i for i, _ in rows(out)} == {i for i, _ in rows(docs)} - leaks

    test_packing.check(stages["best-fit packing"](spark, out, SF).collect(), rows(out))


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and "sequence_id" in got.columns


CLASHING = "copy string, _id string, _copy string, root int, mark int, kept string, score string, predicted string, _row string, n string, item_id long, similarity string, shape string, names string, _hot string"


def odd_table(spark, texts):
    extra = [c.split()[1] for c in CLASHING.split(", ")]
    values = [{"string": "x", "int": 3, "long": 4}[k] for k in extra]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    return spark.createDataFrame([(i, t, None, None, None, *values) for i, t in texts], schema)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, other columns of clashing names, and tables without rows."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    texts = [(1, None), (2, ""), (2, ""), (None, "alone " * 30), (None, "other " * 3), (None, "other " * 3), (3, "OTHER " * 3), (4, "w " * 60_000), (5, f"a {item} b"), (None, f"c {item} d"), (6, "x\x00y\n\n")]
    table = odd_table(spark, texts)
    stages = dict(corpus_pipeline.STAGES)
    left = {}
    for name in ("toxicity", "exact dedup", "SimHash near-dedup", "benchmark decontamination"):
        for docs in (table, table.where("doc_id < 0")):
            out = written(stages[name](spark, docs, SF))
            assert out.columns == docs.columns
            left[name, docs is table] = sorted(rows(out), key=str)
        assert left[name, False] == []
        assert set(left[name, True]) <= set(texts)
    assert left["exact dedup", True] == sorted([(2, ""), (None, "alone " * 30), (3, "OTHER " * 3), (4, "w " * 60_000), (5, f"a {item} b"), (None, f"c {item} d"), (6, "x\x00y\n\n")], key=str)
    assert left["benchmark decontamination", True] == sorted([t for t in texts if item not in (t[1] or "")], key=str)
    marks = {c if c is not None else m for _, m, c in test_simhash_dedup.brute(texts)}  # no identifier names a component of rows without one
    assert len(left["SimHash near-dedup", True]) == len(marks)
    packed = stages["best-fit packing"](spark, table, SF)
    test_packing.check(packed.collect(), texts)
    assert stages["best-fit packing"](spark, table.where("doc_id < 0"), SF).collect() == []


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
