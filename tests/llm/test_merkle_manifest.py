import random
import zlib
from hashlib import sha256

from pyspark.sql import functions as F
from seclake.llm import merkle_manifest, queries
from seclake.llm.common import numbered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, n long, tree string, node string, _at long, proof string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves, fan_out=2):
    """The root, and for each leaf the (left, right) siblings of every level."""
    levels, proofs = [list(leaves)], [[] for _ in leaves]
    while len(levels[-1]) > 1:
        runs = [levels[-1][i : i + fan_out] for i in range(0, len(levels[-1]), fan_out)]
        step = fan_out ** (len(levels) - 1)
        for i, proof in enumerate(proofs):
            at, place = i // step // fan_out, i // step % fan_out
            proof.append((runs[at][:place], runs[at][place + 1 :]))
        levels.append([h(*run) for run in runs])
    return levels[-1][0], proofs


def brute(rows, fan_out=2):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subs = [tree([leaf(r) for r in groups[g]], fan_out) for g in order]
    root, tops = tree([s for s, _ in subs], fan_out)
    out = []
    for g, (subroot, proofs), top in zip(order, subs, tops):
        for row, proof in zip(groups[g], proofs):
            whole = proof + top
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf(row, 1) if bad else leaf(row)
            for left, right in whole:
                node = h(*left, node, *right)
            out.append((row[0], leaf(row), subroot, root, h(*[d for left, right in whole for d in left + right]), node, node == root))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", 5, "p") for r in rows], SCHEMA)


def got(spark, rows, **options):
    bad = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    df = merkle_manifest.manifest(frame(spark, rows), tampered={"n_chars": F.col("n_chars") + 1}, tampered_where=bad, **options)
    return sorted(map(tuple, df.collect()), key=str)


def rows_of(n, seed=1):
    dice = random.Random(seed)
    langs = [None, "", "en", "fr", "zh", "é", "-"]
    rows = [(i if dice.random() > 0.05 else None, dice.choice([None, "", "Straße " * dice.randrange(4), "x\ny"]), dice.choice(langs[:3] * 4 + langs), dice.choice([None, "web"]), dice.choice([None, 0, -3, i])) for i in range(n)]
    return rows + [rows[0]] * 3 + [(7, "z" * 200_000, "alone", None, 1), (7, "y", "en", None, None)]


def test_equals_brute_force(spark):
    rows = rows_of(300)
    want = brute(rows)
    assert {v for *_, v in want} == {True, False}
    assert got(spark, rows) == want
    assert got(spark, rows, span_levels=2) == want  # many rounds up and down
    assert got(spark, rows, span_levels=1, fan_out=3) == brute(rows, 3)


def test_small_tables(spark):
    for n in (0, 1, 2, 3, 5):
        rows = [(i, "t", "en", "s", 1) for i in range(n)]
        assert got(spark, rows) == (brute(rows) if rows else [])


def test_tampering_is_found_where_it_changes_a_value(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0][:2]
    rows = [(ids[0], "t", "en", "s", 1), (ids[1], "t", "en", "s", None)]  # a null stays null
    assert {r[0]: r[-1] for r in got(spark, rows)} == {ids[0]: False, ids[1]: True}


def test_proofs_lead_to_the_root(spark):
    out = merkle_manifest.manifest(frame(spark, rows_of(50)), span_levels=3, with_proof=True).collect()
    for r in out:
        assert merkle_manifest.fold(r.leaf, merkle_manifest._read_steps(r.proof)) == r.root and r.verified


def test_numbers_follow_the_order_in_each_group(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", i * 7 % 101) for i in range(101)] + [("c", None), ("c", 1)], "g string, v long").repartition(5)
    out = numbered(rows, ["g"], ["v"]).collect()
    for g in "abc":
        own = sorted((r for r in out if r.g == g), key=lambda r: (r.v is not None, r.v or 0))
        assert [r._at for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}


def test_query_covers_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    out = queries.QUERIES["op13_merkle_manifest"](spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count() and len({r.root for r in out}) == 1
    assert {r.doc_id for r in out if not r.verified} == {r.doc_id for r in out if zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
