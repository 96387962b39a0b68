"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

1. Shingles of every document meet the shingles of the benchmark. Of two lists of a and b shingles whose similarity is s,
   s / (1 + s) * (a + b) are shared, so every window with so many places that hold a shingle of an item of its size is
   a candidate, wherever they lie in the item; no other window can pass step 4.
2. Each window has the item's number of words and gets a SimHash fingerprint of its shingles.
3. Fingerprints are cut into `radius + 1` blocks. Two that differ in at most `radius` bits agree on a block, so a
   join on (item size, block, value) finds them all; the distance is then counted.
4. The similarity of the shingles, each weighted by how often it occurs (sum of minima over sum of maxima), is
   computed exactly for each candidate.

Everything is DataFrame functions. The benchmark's shingles are broadcast only if they are at most
`broadcast_rows`; beyond that the planner joins them by a shuffle.

Defined results: null texts count as empty and match nothing, nor do items without words; items
shorter than a shingle are one shingle of their own length; a document shorter than an item is one window; repeated rows give
repeated results; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import written
from .common import BLANKS, id_text, text_key, without_rows

BITS = 64


def words(text: Column) -> Column:
    """Words of a text in lower case, at least one (perhaps empty) of them."""
    return F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r")), f"[{BLANKS}]+")


def shingles(word_list: Column, size: int) -> Column:
    """Hashes of each `size` consecutive words."""
    return F.when(F.size(word_list) >= size, F.transform(F.sequence(F.lit(0), F.size(word_list) - size), lambda i: F.xxhash64(*[F.get(word_list, i + j) for j in range(size)])))


def fingerprint(hashes: str, *keys: str):
    """SimHash as an aggregate: a bit is set where more than half of the hashes have it."""
    more = [F.sum(F.when(F.col(hashes).bitwiseAND(F.lit(1 << j if j < 63 else -(1 << 63))) != 0, 1).otherwise(-1)) > 0 for j in range(BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(x, F.lit(1 << j if j < 63 else -(1 << 63))).otherwise(F.lit(0)) for j, x in enumerate(more)])


def blocks(mark: Column, radius: int) -> Column:
    """(number, value) of the radius + 1 blocks of a fingerprint."""
    ends = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(mark, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))])


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays, the weight of a value being how often it occurs."""
    common = F.array_intersect(a, b)
    single = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(common, F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    shared = F.when(single, F.size(common)).otherwise(counted)
    return shared / (F.size(a) + F.size(b) - shared)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The best window of every (document, item) pair of enough similarity: doc_id, item_id, start, n_words, distance, similarity.

    `start` counts words from 0. Options are those of `keyed_matches`.
    """
    return keyed_matches(docs, items, id_col, text_col, **options).drop("copy")


def keyed_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                  shingle: int = 5, similarity: float = 0.8, radius: int = 20, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The matches with the copy (the text's key), by which rows of one identifier differ.

    A radius of 20 bits is over three standard deviations above the distance that is
    expected at a similarity of 0.8.
    """
    own = id_text(items, item_id_col, item_text_col).select(F.col("doc_id").alias("item_id"), words(F.col("text")).alias("w"))
    own = own.where(F.get("w", F.lit(0)) != "").withColumn("n_words", F.size("w")).withColumn("k", F.least(F.lit(shingle), "n_words"))
    sizes = sorted(r.k for r in own.select("k").distinct().collect())  # `shingle` rows at most
    of_size = F.coalesce(*[F.when(F.col("k") == k, shingles(F.col("w"), k)) for k in sizes]) if sizes else F.array().cast("array<bigint>")
    own = written(own.select("item_id", "n_words", "k", of_size.alias("item_shingles")))
    small = own.agg(F.sum(F.size("item_shingles"))).first()[0] or 0
    hint = F.broadcast if small <= broadcast_rows else (lambda table: table)
    placed = own.select("k", "n_words", F.explode("item_shingles").alias("h"))

    texts = id_text(docs, id_col, text_col)
    listed = texts.select("doc_id", text_key(F.col("text")).alias("copy"), words(F.col("text")).alias("w"))
    every = reduce(DataFrame.unionByName, [listed.select("doc_id", "copy", F.size("w").alias("n"), F.lit(k).alias("k"), F.posexplode(shingles(F.col("w"), k)).alias("pos", "h")) for k in sizes or [shingle]])
    # Windows by size, as items of one size share them. A window of enough similarity s has at least s / (1 + s) of its own and
    # its item's shingles in common with the item, so at least so many of its places hold a shingle of an item, whatever lies between.
    hits = every.join(hint(placed.distinct()), ["k", "h"])
    of_item, of_window = F.col("n_words") - F.col("k") + 1, F.least("n", "n_words") - F.col("k") + 1
    need = F.greatest(F.lit(1), F.ceil(similarity / (1 + similarity) * (of_item + of_window) - 1e-9).cast("int"))
    places = hits.groupBy("doc_id", "copy", "k", "n_words", "n").agg(F.sort_array(F.collect_set("pos")).alias("at")).withColumn("need", need).where(F.size("at") >= F.col("need"))
    # Starts of the windows that hold places i to i + need - 1 but not place i - 1; a document shorter than the item has the start 0 only.
    last = F.greatest(F.lit(0), F.col("n") - F.col("n_words"))
    new = lambda i: F.struct(F.greatest(F.lit(0), F.get("at", i + F.col("need") - 1) - of_item + 1, F.coalesce(F.when(i > 0, F.get("at", i - 1)), F.lit(-1)) + 1).alias("first"), F.least(F.get("at", i), last).alias("last"))
    ranges = F.filter(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), new), lambda x: x["first"] <= x["last"])
    whole = F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("last")))
    windows = places.select("doc_id", "copy", "k", "n_words", F.inline(F.when(F.col("n") < F.col("n_words"), whole).otherwise(ranges)))
    wanted = windows.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("k", "n_words", "first", "last")).alias("wanted")).withColumnRenamed("doc_id", "_id").withColumnRenamed("copy", "_copy")
    chosen = texts.withColumn("copy", text_key(F.col("text"))).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy"))).select("doc_id", "copy", words(F.col("text")).alias("w"), "wanted").withColumn("row", F.monotonically_increasing_id())
    by_size = chosen.select("doc_id", "copy", "row", "wanted", F.array(*[shingles(F.col("w"), k) for k in sizes or [shingle]]).alias("s"))
    which = F.create_map(*[F.lit(x) for i, k in enumerate(sizes or [shingle]) for x in (k, i)])
    started = by_size.select("doc_id", "copy", "row", "s", F.inline("wanted")).select("doc_id", "copy", "row", "s", "k", "n_words", F.explode(F.sequence("first", "last")).alias("start"))
    cut = F.slice(F.get("s", which[F.col("k")]), F.col("start") + 1, of_item)
    candidates = written(started.select("doc_id", "copy", "row", "k", "n_words", "start", cut.alias("window")))

    bits = candidates.select("row", "k", "n_words", "start", F.explode("window").alias("h")).groupBy("row", "k", "n_words", "start").agg(fingerprint("h").alias("mark"))
    item_bits = own.select("item_id", "n_words", "k", F.explode("item_shingles").alias("h")).groupBy("item_id", "n_words", "k").agg(fingerprint("h").alias("item_mark"))
    left = bits.select("row", "k", "n_words", "start", "mark", F.inline(blocks(F.col("mark"), radius)))
    right = item_bits.select("item_id", "n_words", "k", "item_mark", F.inline(blocks(F.col("item_mark"), radius)))
    near = left.join(hint(right), ["k", "n_words", "block", "value"]).withColumn("distance", F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))))
    near = near.where(F.col("distance") <= radius).groupBy("row", "k", "n_words", "start", "item_id").agg(F.first("distance").alias("distance"))
    full = near.join(candidates, ["row", "k", "n_words", "start"]).join(hint(own.select("item_id", "item_shingles")), "item_id")
    full = full.withColumn("similarity", weighted_similarity(F.col("window"), F.col("item_shingles"))).where(F.col("similarity") >= similarity - 1e-12)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words", "distance")).alias("best")
    found = full.groupBy("row", "doc_id", "copy", "item_id").agg(best)
    return found.select("doc_id", "copy", "item_id", (-F.col("best.back")).alias("start"), F.col("best.n_words").alias("n_words"), F.col("best.distance").alias("distance"), F.col("best.similarity").alias("similarity"))


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    leaked = keyed_matches(docs, items, id_col, text_col, **options).select("doc_id", "copy").distinct()
    return without_rows(docs, leaked, id_col=id_col, text_col=text_col)
