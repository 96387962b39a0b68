"""SimHash near-duplicates: tiled exact comparison of fingerprints, then connected components.

Fingerprints of all documents are reduced to the distinct ones. Cut into `radius + agree` blocks, two that differ in at
most `radius` bits have `agree` blocks in common, so each fingerprint is dealt to one group for each choice of `agree`
blocks. `agree` is the least for which evenly spread fingerprints make groups within `group_rows`, which keeps the comparisons
in proportion to the input. A group that is larger all the same is cut into parts by a second hash, and every pair of
parts becomes a group of its own, so that no task holds more than about twice `group_rows`. Within a group, fingerprints are sorted by population count and cut into tiles; tile pairs whose counts differ
beyond the radius are skipped, all others are compared whole with exclusive-or and bit counts. A group gives one link
for each member (to the smallest fingerprint it is joined to), never all pairs. Components of these links are found
by rounds of hooking to the smallest neighbour, each stored in the shared folder.

Defined results: null and empty texts have fingerprint zero, which is linked like any other; texts with fewer words than
a shingle have one shingle of them all; repeated rows repeat their result; a null identifier belongs to its
component but does not name it unless it has no other; an empty table gives no rows; other columns are ignored. Of the rows
that `one_of_each` is given, one is left of each component, also where rows repeat the identifier that names it or have none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import written
from .common import id_text, skew_join, text_bytes, text_key, without_rows

BITS, SEED = 64, 42


def simhash(text: bytes, shingle: int) -> int:
    """The fingerprint of a text: a bit is set where more than half of its shingles' hashes have it."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], dtype="<u8")
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 100_000):
        part = hashes[at : at + 100_000]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, copy, mark): the text's key, and the mark as a signed 64-bit number."""
    table = id_text(docs, id_col, text_col).withColumn("copy", text_key(F.col("text")))
    kind = table.schema["doc_id"].dataType.simpleString()

    def marks(batches):
        import pyarrow as pa

        for batch in batches:
            found = np.array([simhash(t, shingle) for t in text_bytes(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found)], names=["doc_id", "copy", "mark"])

    return table.mapInArrow(marks, f"doc_id {kind}, copy long, mark long")


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the components that the pairs (a, b) connect; labels become the smallest index of each."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def tiled_links(marks: np.ndarray, radius: int, tile: int = 1024) -> np.ndarray:
    """For each distinct mark the index of its component's first mark, by comparing tiles of them."""
    counts = np.bitwise_count(marks)
    order = np.argsort(counts, kind="stable")
    marks, counts = marks[order], counts[order].astype(np.int16)
    labels = np.arange(len(marks))
    for i in range(0, len(marks), tile):
        left = marks[i : i + tile, None]
        highest = counts[min(i + tile, len(marks)) - 1]
        for j in range(i, len(marks), tile):
            if counts[j] - highest > radius:
                break
            near = np.bitwise_count(left ^ marks[None, j : j + tile]) <= radius
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            different = labels[a] != labels[b]
            if different.any():
                join_labels(labels, a[different], b[different])
    out = np.empty(len(marks), np.int64)
    out[order] = order[labels]
    return out


def links(marks: DataFrame, radius: int, group_rows: int = 20_000, agree: int | None = None) -> DataFrame:
    """(a, b): links between distinct marks whose components are those of all pairs within the radius."""
    if agree is None:
        n = marks.count()
        agree = next((k for k in range(1, 5) if n / 2 ** (BITS * k // (radius + k)) <= group_rows / 10), 5)
    cuts = radius + agree
    ends = [BITS * i // cuts for i in range(cuts + 1)]
    masks = [sum(((1 << (ends[i + 1] - ends[i])) - 1) << ends[i] for i in chosen) for chosen in combinations(range(cuts), agree)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    block = F.array(*[F.struct(F.lit(i).alias("block"), F.col("mark").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed)])
    dealt = marks.select("mark", F.inline(block))
    sizes = written(dealt.groupBy("block", "value").count().where(F.col("count") > group_rows))
    bounded = sizes.count() <= 100_000
    many = dealt.join(F.broadcast(sizes) if bounded else sizes, ["block", "value"], "left")
    parts = F.coalesce(F.ceil(F.col("count") / group_rows), F.lit(1))
    own = F.pmod(F.xxhash64("mark"), F.col("parts"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda u: F.struct(F.least(u, own).alias("p"), F.greatest(u, own).alias("q"))))
    work = many.withColumn("parts", parts).select("mark", "block", "value", pair.alias("pair")).select("mark", F.xxhash64("block", "value", "pair.p", "pair.q").alias("task"))
    tasks = work.repartition("task").sortWithinPartitions("task")

    def compare(batches):
        import pyarrow as pa

        def given(task_marks):
            marks = np.unique(task_marks)
            if len(marks) < 2:
                return None
            first = tiled_links(marks.view(np.uint64), radius)
            linked = first != np.arange(len(marks))
            return marks[linked], marks[first[linked]]

        open_task, held = None, []

        def closed():
            found = given(np.concatenate(held)) if held else None
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"]) if found and len(found[0]) else None

        for batch in batches:
            task, mark = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for part in np.split(np.arange(len(task)), np.nonzero(np.diff(task))[0] + 1):
                if not len(part):
                    continue
                if task[part[0]] != open_task:
                    if (out := closed()) is not None:
                        yield out
                    open_task, held = task[part[0]], []
                held.append(mark[part])
        if (out := closed()) is not None:
            yield out

    return tasks.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(mark, root): each linked mark's smallest reachable mark.

    Rounds of: every vertex takes the smallest label among itself and its neighbours, then the label of its label.
    Ends when a round changes nothing.
    """
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degrees = both.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    hubs = written(degrees.where(F.col("n") > max(1, both.count() // 1000)).select("b"))
    labels = written(both.groupBy(F.col("a").alias("mark")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        seen = skew_join(both, labels.withColumnRenamed("mark", "b"), ["b"], "inner", hubs, stored=True)
        lower = seen.groupBy(F.col("a").alias("mark")).agg(F.min("root").alias("near"))
        hooked = written(labels.join(lower, "mark").select("mark", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        jump = hooked.select(F.col("mark").alias("root"), F.col("root").alias("up"))
        new = written(skew_join(hooked, jump, ["root"], "inner").select("mark", "old", F.least("root", "up").alias("root")))
        changed = new.where(F.col("root") != F.col("old")).limit(1).count()
        labels = new.select("mark", "root")
        if not changed:
            return labels


def _placed(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4, radius: int = 4, group_rows: int = 20_000, agree: int | None = None) -> DataFrame:
    """doc_id, copy, mark, root (the component's smallest mark) and component_id of all rows."""
    rows = written(fingerprints(docs, id_col, text_col, shingle))
    marks = written(rows.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    found = written(links(marks.select("mark"), radius, group_rows, agree))
    roots = components(found)
    rooted = marks.join(roots, "mark", "left").select("mark", "first", "n", F.coalesce("root", "mark").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(skew_join(written(rooted), written(smallest), ["root"], "inner").select("mark", "root", "component_id", "n"))
    heavy = named.where(F.col("n") > F.greatest(F.lit(1), F.lit(rows.count() / 1000)))
    return skew_join(rows, named.drop("n"), ["mark"], "inner", heavy)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, group_rows: int = 20_000, agree: int | None = None) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable)."""
    joined = _placed(docs, id_col, text_col, shingle, radius, group_rows, agree)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The document that names each component, one row of each, with all its columns."""
    placed = _placed(docs, id_col, text_col, **options).withColumn("names", F.col("doc_id").eqNullSafe(F.col("component_id")))
    keys = written(placed.groupBy("doc_id", "copy", "root", "names").agg(F.count(F.lit(1)).alias("n")))
    # Of a component's rows with the identifier that names it, the one with the least copy.
    first = keys.where("names").groupBy("root").agg(F.min("copy").alias("first"), F.count(F.lit(1)).alias("copies"))
    more = written(first.where(F.col("copies") > 1))
    others = keys.where("names").join(more, "root").where(F.col("copy") != F.col("first"))
    dropped = keys.where(~F.col("names")).select("doc_id", "copy").unionByName(others.select("doc_id", "copy"))
    repeated = keys.where(F.col("names") & (F.col("n") > 1)).select("doc_id", "copy")
    return without_rows(docs, dropped, repeated, id_col, text_col)
