import math

import numpy as np
from seclake.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, size int, number long, links string, p0 int"


def brute(rows, similarity=0.9):
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    def able(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = [0] * len(rows)
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if able(a) and able(b) and len(a) == len(b) and embedding_dedup.cosine(np.array(a, float), np.array(b, float)) >= similarity:
                links[i] += 1
                links[j] += 1
                part[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min([x for x in (least.get(root(i)), doc) if x is not None], default=None)
    return sorted(((doc, links[i], least[root(i)], doc == least[root(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def vectors(seed, n=150, size=12):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(6, size))
    out = [np.float32(centres[i % 6] + dice.normal(size=size) * dice.choice([0.05, 0.4, 1.5])).tolist() for i in range(n)]
    rows = list(enumerate(out, 1000))
    rows += [(2000 + i, rows[0][1]) for i in range(40)] + [(5, rows[1][1]), (5, rows[1][1]), (5, rows[2][1]), (None, rows[3][1]), (None, [3.0] + [0.0] * (size - 1))]
    rows += [(3000, [2 * x for x in rows[4][1]]), (3001, [-x for x in rows[4][1]]), (3002, None), (3003, []), (3004, [0.0] * size), (3005, [-0.0] * size), (3006, rows[0][1][:-1] + [None])]
    rows += [(3007, [math.nan] + rows[0][1][1:]), (3008, [math.inf] + rows[0][1][1:]), (3009, rows[0][1][:5]), (3010, rows[0][1][:5]), (3011, [1.0]), (3012, [7.0]), (None, None)]
    rows += [(3020, [1e38] * size), (3021, [3e37] * size), (3022, [1e-40] * size)]
    return rows


def got(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x", 4) for i, v in rows], schema)


def test_equals_brute_force(spark):
    rows = vectors(1)
    want = brute(rows)
    assert len({c for _, n, c, _ in want if n}) > 3 and any(n == 0 for _, n, _, _ in want)
    df = frame(spark, rows)
    assert got(embedding_dedup.near_duplicates(df.repartition(3))) == want
    assert got(embedding_dedup.near_duplicates(df, interval_rows=8, fan=2, leading=3, fit_rows=50)) == want


def test_doubles_and_other_thresholds(spark):
    rows = [(i, v) for i, v in vectors(2, 60, 5)]
    df = frame(spark, rows, SCHEMA.replace("float", "double"))
    for similarity in (0.5, 0.99, 1.0):
        assert got(embedding_dedup.near_duplicates(df, similarity=similarity, interval_rows=16)) == brute(rows, similarity)


def test_pairs_at_the_threshold(spark):
    # (1, 0) and (9, sqrt(19)) have a cosine of 0.9 up to rounding; whole numbers decide it exactly: 0.6 and 0.8.
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [4.0, 3.0]), (4, [-4.0, 3.0])]
    for similarity in (0.6, 0.8, 0.96):
        assert got(embedding_dedup.near_duplicates(frame(spark, rows), similarity=similarity)) == brute(rows, similarity)


def test_empty_table(spark):
    assert embedding_dedup.near_duplicates(frame(spark, [(1, [1.0])]).where("vec_id < 0")).collect() == []
    assert got(embedding_dedup.near_duplicates(frame(spark, [(1, None), (None, None)]))) == sorted([(1, 0, 1, True), (None, 0, None, True)], key=str)


def test_halving_meets_every_pair_once():
    dice = np.random.default_rng(5)
    points = dice.normal(size=(90, 4)) + 3 * dice.integers(0, 2, size=(90, 1))
    side = lambda a, b: embedding_dedup.Interval(np.arange(a, b), np.ones(b - a, np.int64), np.array([embedding_dedup.unit(p) for p in points[a:b]])[:, :2], points[a:b])
    epsilon = math.sqrt(0.2) + 1e-6
    want = sum(embedding_dedup.cosine(points[i], points[j]) >= 0.9 for i in range(90) for j in range(i))
    one = side(0, 90)
    whole = embedding_dedup.Links(one, one, 0.9, epsilon, 7)
    whole.join(0, 90, 0, 90)
    assert whole.left_links.sum() == 2 * want
    parts, total = [side(0, 37), side(37, 90)], 0
    for i in range(2):
        for j in range(i, 2):
            links = embedding_dedup.Links(parts[i], parts[j], 0.9, epsilon, 5)
            links.join(0, len(parts[i]), 0, len(parts[j]))
            total += links.left_links.sum() + (0 if i == j else links.right_links.sum())
    assert total == 2 * want


def test_distant_intervals_are_skipped(spark):
    """Vectors in a few narrow bundles: pairs of intervals of different bundles are not compared."""
    dice = np.random.default_rng(6)
    rows = [(i * 100 + j, tuple(float(x) for x in np.eye(8)[i] + dice.normal(size=8) * 0.01)) for i in range(8) for j in range(32)]
    epsilon = math.sqrt(0.2) + 1e-6
    at = {i: np.array([embedding_dedup.unit(np.array(v)) for k, v in rows if k // 100 == i]) for i in range(8)}
    table = spark.createDataFrame([(8, i, *map(float, u)) for i in range(8) for u in at[i]], "size int, interval long, " + ", ".join(f"p{i} double" for i in range(8)))
    assert sorted(map(tuple, embedding_dedup.interval_pairs(table, epsilon, 8, fan=2).collect())) == [(8, i, i) for i in range(8)]
