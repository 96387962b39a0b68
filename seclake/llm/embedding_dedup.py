"""Embedding near-duplicates by an epsilon grid order join.

Two unit vectors have a cosine of at least `similarity` where their distance is at most epsilon = sqrt(2 - 2 * similarity), and a
rotation keeps distances, so vectors whose leading coordinates lie further apart than that cannot link.

1. Equal vectors become one, which carries their number; the rest works on different vectors only.
2. Leading principal dimensions are fitted on a sample of at most `fit_rows` vectors. They only decide the order of
   the work: any orthonormal axes give the same links.
3. Vectors are sorted by their grid cells, of side epsilon, dimension after dimension, and the sequence is cut into intervals of
   `interval_rows`, each with the bounds of its coordinates.
4. Intervals are joined recursively: a tree of `fan` intervals a node is walked from the root, as joins of node pairs with their
   children, and pairs whose bounds lie further apart than epsilon end there.
5. A task joins one pair of intervals, again recursively: the longer one is halved until both are short, pairs that are provably
   distant are skipped, all others are compared whole. Single precision with a proven margin screens, doubles decide.
   A pair of intervals gives each vector's number of links and a spanning forest, never all pairs.
6. Components of the forests are found by rounds of hooking (`simhash_dedup.components`).

Where vectors are spread over many dimensions alike, few intervals are provably distant, and the work is that of comparing
all pairs of intervals, a bounded pair a task; the join stays exact.

Defined results: vectors that are null, empty, zero or hold a null or a component that is not finite link with nothing, not even with
equal ones; vectors of different lengths link with nothing of each other; rows that repeat an identifier are vectors of their own;
a null identifier belongs to its component, but does not name it unless no other is there; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import written
from .common import named, numbered, skew_join
from .simhash_dedup import components, join_labels

SIMILARITY, LEADING = 0.9, 8
#: Bits of a vector's number that count within its length.
_PLACE_BITS = 40
#: Cosines closer to the threshold than this are decided by exact sums.
_CLOSE = 1e-12


def unit(vector: np.ndarray) -> np.ndarray:
    """The vector, in doubles, divided by its length; scaled first, so that no square overflows or vanishes."""
    scaled = vector / np.abs(vector).max()
    return scaled / math.sqrt(math.fsum(scaled * scaled))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of two vectors by exact sums of double products."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def distinct_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, class, size, vector): what equal vectors share, their number of components and their bytes, null where a vector cannot link."""
    table = named(rows, vec_id=id_col, vector=vector_col)
    element = "float" if "float" in table.schema["vector"].dataType.simpleString() else "double"
    table = table.select("vec_id", F.col("vector").cast(f"array<{element}>").alias("vector"))
    kind, form = table.schema["vec_id"].dataType.simpleString(), "<f4" if element == "float" else "<f8"

    def classes(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            marks, sizes, blobs = [], [], []
            lists = batch.column(1)
            offsets, valid = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            whole = np.asarray(lists.values.to_numpy(zero_copy_only=False), form)  # a null component becomes one that is not a number
            for row in range(len(lists)):
                vector = whole[offsets[row] : offsets[row + 1]] + 0.0 if valid[row] else whole[:0]  # no negative zero
                if len(vector) and np.isfinite(vector).all() and vector.any():
                    data = vector.astype(form).tobytes()
                    marks.append(hashlib.blake2b(data, digest_size=16).digest())
                    sizes.append(len(vector))
                    blobs.append(data)
                else:
                    marks.append(None)
                    sizes.append(None)
                    blobs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], names=["vec_id", "class", "size", "vector"])

    return table.mapInArrow(classes, f"vec_id {kind}, class binary, size int, vector binary")


def leading_axes(vectors: DataFrame, form: str, leading: int, fit_rows: int, fit_bytes: int) -> dict[int, np.ndarray]:
    """The leading principal axes of the commonest length, fitted on at most `fit_rows` vectors; other lengths keep their own first axes."""
    common = vectors.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return {}
    most = max(1, min(fit_rows, fit_bytes // (8 * common["size"])))
    sample = vectors.where(F.col("size") == common["size"]).orderBy("class").limit(most).select("vector").collect()
    units = np.array([unit(np.frombuffer(r.vector, form).astype(float)) for r in sample])
    _, axes = np.linalg.eigh(units.T @ units - len(units) * np.outer(units.mean(0), units.mean(0)))
    return {common["size"]: axes[:, ::-1][:, :leading].copy()}


def _coordinates(units: np.ndarray, axes: np.ndarray | None, leading: int) -> np.ndarray:
    """Leading coordinates, zero beyond the vector's own."""
    found = units[:, :leading] if axes is None else units @ axes
    return np.pad(found, ((0, 0), (0, leading - found.shape[1])))


def _ordered(vectors: DataFrame, form: str, axes: dict[int, np.ndarray], epsilon: float, leading: int) -> DataFrame:
    """Adds `cells`, bytes whose order is the epsilon grid order, and the coordinates p0, p1, ..."""
    names = [f.name for f in vectors.schema]

    def placed(batches):
        import pyarrow as pa

        for batch in batches:
            size, blobs = batch.column(names.index("size")).to_numpy(), batch.column(names.index("vector")).to_pylist()
            at = np.zeros((len(size), leading))
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                units = np.array([unit(np.frombuffer(blobs[i], form).astype(float)) for i in rows])
                at[rows] = _coordinates(units, axes.get(int(n)), leading)
            cells = np.clip(np.floor(at / epsilon) + (1 << 15), 0, (1 << 16) - 1).astype(">u2")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c.tobytes() for c in cells], pa.binary()), *(pa.array(at[:, i]) for i in range(leading))],
                names=[*names, "cells", *(f"p{i}" for i in range(leading))],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(placed, f"{fields}, cells binary" + "".join(f", p{i} double" for i in range(leading)))


def _bounds(rows: DataFrame, leading: int, parent: Column) -> DataFrame:
    aggregates = [g for i in range(leading) for g in (F.min(f"l{i}").alias(f"l{i}"), F.max(f"h{i}").alias(f"h{i}"))]
    return rows.groupBy("size", parent.alias("node")).agg(*aggregates)


def interval_pairs(vectors: DataFrame, epsilon: float, leading: int = LEADING, fan: int = 16) -> DataFrame:
    """(size, a, b), a <= b: the pairs of intervals whose bounds are within epsilon, found from the root of their tree down.

    `vectors` has the columns size, interval and the coordinates p0, p1, ...
    """
    points = vectors.select("size", "interval", *[F.col(f"p{i}").alias(f"{e}{i}") for i in range(leading) for e in "lh"])
    levels = [written(_bounds(points, leading, F.col("interval")))]
    while levels[-1].where("node > 0").limit(1).count():
        levels.append(written(_bounds(levels[-1], leading, F.floor(F.col("node") / fan).cast("long"))))
    pairs = levels[-1].select("size", F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        sides = [level.select("size", F.floor(F.col("node") / fan).cast("long").alias(s), F.col("node").alias(f"{s}_node"), *[F.col(f"{e}{i}").alias(f"{s}_{e}{i}") for i in range(leading) for e in "lh"]) for s in "ab"]
        met = pairs.join(sides[0], ["size", "a"]).join(sides[1], ["size", "b"]).where("a_node <= b_node")
        gaps = [F.greatest(F.lit(0.0), F.col(f"a_l{i}") - F.col(f"b_h{i}"), F.col(f"b_l{i}") - F.col(f"a_h{i}")) for i in range(leading)]
        near = sum((g * g for g in gaps), F.lit(0.0)) <= epsilon * epsilon
        pairs = written(met.where(near).select("size", F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    return pairs


class Interval:
    """Consecutive vectors of the grid order, as the join compares them."""

    def __init__(self, numbers: np.ndarray, counts: np.ndarray, coordinates: np.ndarray, raw: np.ndarray) -> None:
        self.numbers, self.counts, self.coordinates, self.raw = numbers, counts, coordinates, raw
        self.units = np.array([unit(v) for v in raw.astype(float)]).reshape(raw.shape)
        self.single = self.units.astype(np.float32)
        self._box: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return len(self.numbers)

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self._box:
            part = self.coordinates[a:b]
            self._box[a, b] = part.min(0), part.max(0)
        return self._box[a, b]


class Links:
    """Number of links and a spanning forest, gathered while two intervals are joined."""

    def __init__(self, left: Interval, right: Interval, similarity: float, epsilon: float, short: int) -> None:
        self.left, self.right, self.same = left, right, left is right
        self.similarity, self.epsilon, self.short = similarity, epsilon, short
        size = left.units.shape[1] if len(left) else 0
        # Rounding to single precision, products and sums: each bounded by so many units of its precision.
        self.margin = (size + 8) * 2.0**-23
        self.left_links = np.zeros(len(left), np.int64)
        self.right_links = self.left_links if self.same else np.zeros(len(right), np.int64)
        self.labels = np.arange(len(left) + (0 if self.same else len(right)))
        self.shift = 0 if self.same else len(left)

    def join(self, a: int, b: int, c: int, d: int) -> None:
        """Join left[a:b] with right[c:d]."""
        (low, high), (from_, to) = self.left.box(a, b), self.right.box(c, d)
        gap = np.maximum(0, np.maximum(low - to, from_ - high))
        if gap @ gap > self.epsilon**2:
            return
        if max(b - a, d - c) <= self.short:
            self.compare(a, b, c, d)
        elif self.same and a == c:  # split alike, so that no pair is met twice
            half = (a + b) // 2
            self.join(a, half, a, half)
            self.join(a, half, half, b)
            self.join(half, b, half, b)
        elif b - a >= d - c:
            self.join(a, (a + b) // 2, c, d)
            self.join((a + b) // 2, b, c, d)
        else:
            self.join(a, b, c, (c + d) // 2)
            self.join(a, b, (c + d) // 2, d)

    def compare(self, a: int, b: int, c: int, d: int) -> None:
        screened = self.left.single[a:b] @ self.right.single[c:d].T >= self.similarity - self.margin
        if self.same and a == c:
            screened &= np.triu(np.ones(screened.shape, bool), 1)
        rows = np.flatnonzero(screened.any(1))
        if not len(rows):
            return
        columns = np.flatnonzero(screened[rows].any(0))
        cosines = self.left.units[a + rows] @ self.right.units[c + columns].T
        near = (cosines >= self.similarity) & screened[np.ix_(rows, columns)]
        for i, j in zip(*np.nonzero((np.abs(cosines - self.similarity) < _CLOSE) & screened[np.ix_(rows, columns)]), strict=True):
            near[i, j] = cosine(self.left.raw[a + rows[i]].astype(float), self.right.raw[c + columns[j]].astype(float)) >= self.similarity
        self.left_links[a + rows] += near @ self.right.counts[c + columns]
        self.right_links[c + columns] += self.left.counts[a + rows] @ near
        i, j = np.nonzero(near)
        join_labels(self.labels, a + rows[i], self.shift + c + columns[j])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, links, first vector of its tree) of all vectors with links."""
        numbers = self.left.numbers if self.same else np.concatenate([self.left.numbers, self.right.numbers])
        links = self.left_links if self.same else np.concatenate([self.left_links, self.right_links])
        some = np.flatnonzero(links)
        return numbers[some], links[some], numbers[self.labels[some]]


def joined(vectors: DataFrame, pairs: DataFrame, form: str, similarity: float, epsilon: float, leading: int, short: int = 512) -> DataFrame:
    """(number, links, first): a row for each pair of intervals and each vector of theirs that has links there.

    `vectors` has the columns size, interval, number, copies, vector and the coordinates p0, p1, ...
    """
    fields = ["size", "interval", "number", "copies", "vector", *[f"p{i}" for i in range(leading)]]

    def packed(table):
        """One row an interval."""
        import pyarrow as pa

        order = table.column("number").to_numpy().argsort()
        numbers, copies = (table.column(c).to_numpy()[order].astype("<i8") for c in ("number", "copies"))
        coordinates = np.stack([table.column(f"p{i}").to_numpy()[order] for i in range(leading)], axis=1).astype("<f8")
        raw = table.column("vector").take(pa.array(order)).to_pylist()
        data = b"".join([numbers.tobytes(), copies.tobytes(), coordinates.tobytes(), *raw])
        return pa.table({"size": table.column("size")[:1], "interval": table.column("interval")[:1], "data": pa.array([data], pa.binary())})

    def opened(size: int, data: bytes) -> Interval:
        rows = len(data) // (16 + 8 * leading + size * np.dtype(form).itemsize)
        numbers, copies = np.frombuffer(data, "<i8", rows), np.frombuffer(data, "<i8", rows, 8 * rows)
        coordinates = np.frombuffer(data, "<f8", rows * leading, 16 * rows).reshape(rows, leading)
        return Interval(numbers, copies, coordinates, np.frombuffer(data, form, rows * size, (16 + 8 * leading) * rows).reshape(rows, size))

    def met(table):
        import pyarrow as pa

        size, data = table.column("size")[0].as_py(), table.column("data")
        sides = [opened(size, data[int(i)].as_buffer()) for i in table.column("side").to_numpy().argsort()]
        links = Links(sides[0], sides[-1], similarity, epsilon, short)
        links.join(0, len(sides[0]), 0, len(sides[-1]))
        return pa.table([pa.array(x) for x in links.found()], names=["number", "links", "first"])

    blobs = written(vectors.select(*fields).groupBy("size", "interval").applyInArrow(packed, "size int, interval long, data binary"))
    side = lambda i, c: F.struct(F.lit(i).alias("side"), F.col(c).alias("interval"))
    asked = pairs.select("size", "a", "b", F.inline(F.when(F.col("a") == F.col("b"), F.array(side(0, "a"))).otherwise(F.array(side(0, "a"), side(1, "b")))))
    work = asked.join(blobs, ["size", "interval"]).select("size", "a", "b", "side", "data")
    return work.groupBy("size", "a", "b").applyInArrow(met, "number long, links long, first long")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY, leading: int = LEADING, interval_rows: int = 4096,
                    interval_bytes: int = 16 << 20, fan: int = 16, fit_rows: int = 4096, fit_bytes: int = 8 << 20) -> DataFrame:
    """One row a vector: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be in (0, 1]")
    # A little wider than the exact distance, for what doubles round off.
    epsilon = math.sqrt(max(0.0, 2 - 2 * similarity)) + 1e-6
    stored = written(distinct_vectors(rows, id_col, vector_col))
    form = "<f4" if "float" in rows.schema[vector_col].dataType.simpleString() else "<f8"
    classes = stored.where(F.col("class").isNotNull()).groupBy("class", "size").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"), F.first("vector").alias("vector"))
    classes = written(classes)
    axes = leading_axes(classes, form, leading, fit_rows, fit_bytes)
    placed = numbered(written(_ordered(classes, form, axes, epsilon, leading)), ["size"], ["cells", "class"]).drop("n", "cells")
    bytes_each = F.col("size") * np.dtype(form).itemsize + 16 + 8 * leading
    interval = F.floor(F.col("_at") / F.greatest(F.lit(1), F.least(F.lit(interval_rows), F.floor(F.lit(interval_bytes) / bytes_each)))).cast("long")
    number = F.shiftleft(F.col("size").cast("long"), _PLACE_BITS) + F.col("_at")
    vectors = written(placed.withColumn("interval", interval).withColumn("number", number))
    found = written(joined(vectors, interval_pairs(vectors, epsilon, leading, fan), form, similarity, epsilon, leading))
    counts = found.groupBy("number").agg(F.sum("links").alias("links"))
    roots = components(found.where("number != first").select(F.col("number").alias("a"), F.col("first").alias("b")))
    rooted = vectors.select("number", "class", "copies", "first_id").join(counts, "number", "left").join(roots.withColumnRenamed("mark", "number"), "number", "left")
    rooted = written(rooted.select("class", "copies", "first_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "number").alias("root")))
    smallest = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named_classes = written(skew_join(rooted, smallest, ["root"], "inner").select("class", "component_id", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links")))
    able = stored.where(F.col("class").isNotNull()).select("vec_id", "class")
    heavy = named_classes.where(F.col("copies") > F.greatest(F.lit(1), F.lit(stored.count() / 1000)))
    linked = skew_join(able, named_classes.drop("copies"), ["class"], "inner", heavy).select("vec_id", "n_links", "component_id")
    alone = stored.where(F.col("class").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
