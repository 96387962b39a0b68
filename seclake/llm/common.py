"""Pieces that several operators share: input columns, words, joins on hot keys, tables cut from their lineage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.workspace import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, as the inside of a regular-expression class.
BLANKS = r"\x20\x09-\x0D"


def named(table: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; whatever else the table holds is left out."""
    return table.select(*[F.col(f"`{name}`").alias(own) for own, name in columns.items()])


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones."""
    return named(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text"), F.lit("")))


def text_key(text: Column) -> Column:
    """What tells rows of one identifier apart: a hash of the text, null texts as empty ones."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without_rows(docs: DataFrame, dropped: DataFrame, repeated: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose (doc_id, copy), the copy being the text's key, is not among `dropped`; all their columns.

    Of the rows that share a (doc_id, copy) of `repeated` one is left, by the hash of all its columns. Both tables
    hold a key once; null identifiers are equal.
    """
    own_id, own_copy = F.col(f"`{id_col}`"), text_key(F.col(f"`{text_col}`"))
    among = lambda keys: own_id.eqNullSafe(keys["_id"]) & (own_copy == keys["_copy"])
    as_keys = lambda keys: keys.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"))
    gone = as_keys(dropped)
    left = docs.join(gone, among(gone), "left_anti")
    if repeated is None or repeated.limit(1).count() == 0:
        return left
    many = as_keys(repeated)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = left.join(many, among(many), "left_semi").groupBy(own_id.alias("_id"), own_copy.alias("_copy")).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row"))
    return left.join(many, among(many), "left_anti").unionByName(one.select("_row.*"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the identifier's decimal text leaves this remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", heavy: DataFrame | None = None, share: int = 1000, stored: bool = False) -> DataFrame:
    """Join rows with a table that has one row a key, where a few keys may hold most of the rows.

    Keys with more than one row in `share` are at most `share` many, so that their side of `right` can be
    broadcast however large the tables are. All other keys are joined by a shuffle, in which none can
    load one task. `heavy` names the hot keys where the caller has counted them already; `stored` says that it is a small stored table. Both tables are
    read twice: pass stored ones. Keys must not be null.
    """
    keys = list(keys)
    if heavy is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        total = left.count()
        heavy = counts.where(F.col("_rows") > max(1, total // share)).select(*keys)
    heavy = (heavy if stored else written(heavy.select(*keys))).select(*keys).withColumn("_hot", F.lit(True))
    flagged = left.join(F.broadcast(heavy), keys, "left")
    hot_right = right.join(F.broadcast(heavy.select(*keys)), keys, "left_semi")
    hot = flagged.where(F.col("_hot")).drop("_hot").join(F.broadcast(hot_right), keys, how)
    cold = flagged.where(F.col("_hot").isNull()).drop("_hot").join(right, keys, how)
    return hot.unionByName(cold)


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with their place `_at`, from 0, in the order of their group, and `n`, the group's number of rows.

    Rows are sorted by ranges, so that a group of any size is spread; a row's place is its place in its partition and the
    count of the group's rows in partitions before. Equal rows stay in the order in which they are stored. Pass a stored table;
    groups must not be null.
    """
    group, order = list(group), list(order)
    keys = [*group, *order, "_row"]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    whole = Window.partitionBy(*group)
    before = F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")
    starts = counts.select("_part", *group, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    return ranged.join(starts, ["_part", *group]).withColumn("_at", F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def bounded_sample(rows: DataFrame, class_col: str, most_rows: int, most_bytes: int) -> DataFrame:
    """Of the (class, text) rows at most `most_rows` different texts a class and `most_bytes` bytes of text in all.

    Texts are taken in the order of their hash, so the sample does not depend on how the table is stored. A class
    with more rows is thinned by that hash in the scan, before anything is shuffled.
    """
    counts = {r[class_col]: r["count"] for r in rows.groupBy(class_col).count().collect()}
    at = F.xxhash64("text")
    share = most_bytes // max(1, len(counts))
    thin = F.lit(False)
    for name, n in counts.items():
        thin = thin | ((F.col(class_col) == F.lit(name)) & (F.pmod(at, F.lit(1 << 20)) <= F.lit(int(1.5 * most_rows / n * (1 << 20)))))
    few = rows.where(thin).where(F.octet_length("text") <= share).select(class_col, "text", at.alias("_at")).dropDuplicates([class_col, "_at"])
    order = Window.partitionBy(class_col).orderBy("_at")
    ranked = few.withColumn("_n", F.row_number().over(order)).withColumn("_sum", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where((F.col("_n") <= most_rows) & (F.col("_sum") <= share)).select(class_col, "text")


class Codes(dict):
    """Numbers of words in the order in which they are first seen, with the words' 64-bit hashes."""

    def __init__(self, seed: int = 0) -> None:
        super().__init__()
        self.seed, self.hashes = seed, []
        self._table = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self.hashes.append(xxhash.xxh3_64_intdigest(word, self.seed))
        code = self[word] = len(self)
        return code

    def table(self) -> np.ndarray:
        """The hashes by number."""
        new = self.hashes[len(self._table) :]
        if new:
            self._table = np.concatenate([self._table, np.array(new, np.uint64)])
        return self._table

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


def text_parts(batch, column: int, most_bytes: int = 8 << 20) -> Iterator:
    """An Arrow batch in consecutive slices of about so many bytes of text."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // most_bytes)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(column) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()
