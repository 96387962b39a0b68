"""Removal of lines that many documents share.

Texts are split at line feeds, a line's key is the line without surrounding blanks and with A-Z lower-cased, and two
64-bit hashes stand for the key. Each document names each of its keys once, keys are counted with partial sums
before the shuffle, and keys over the threshold go back to the documents' (document, position, key) rows; a key that
a third of all documents hold is joined by broadcast, of which there can be fewer than a thousand. The texts move
once, to meet the flags of their lines in order of position.

Defined results: a null or empty text is one empty line, and keys shorter than `min_length` code points are never
dropped; rows that repeat a document count as further documents, unless `by_id` asks for different identifiers, where rows without one
count for nothing; a document of which every line
goes has the empty text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import written
from .common import ascii_lower, id_text, skew_join

_BLANK = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_BLANK)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _by_id(keys: DataFrame, named: DataFrame) -> DataFrame:
    """The named keys, each counting as one document for each identifier. Only identifiers of several texts need a second look."""
    several = written(keys.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id"))
    if several.limit(1).count() == 0:
        return named.withColumn("_documents", F.when(F.col("doc_id").isNotNull(), 1).otherwise(0).cast("long"))
    flagged = named.join(several.withColumn("_several", F.lit(True)), "doc_id", "left")
    first = flagged.withColumn("_documents", F.when(F.col("doc_id").isNotNull() & F.col("_several").isNull(), 1).otherwise(0).cast("long"))
    once = named.join(several, "doc_id", "left_semi").select("doc_id", "a", "b").distinct()
    return first.drop("_several").unionByName(once.withColumn("_rows", F.lit(0).cast("long")).withColumn("_documents", F.lit(1).cast("long")))


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 1, min_documents: int = 10, by_id: bool = False) -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped, text (what is left)."""
    texts = id_text(docs, id_col, text_col).withColumn("_copy", F.xxhash64("text"))
    hashed = F.transform(_lines(ascii_lower(F.col("text"))), lambda x: F.btrim(x, F.lit(_BLANK)))
    keys = texts.select("doc_id", "_copy", F.transform(hashed, lambda k: F.when(F.char_length(k) >= min_length, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b")))).alias("keys"))
    # Equal rows are one here, as their flags are equal; how often they occur counts below.
    keys = written(keys.groupBy("doc_id", "_copy").agg(F.first("keys").alias("keys"), F.count(F.lit(1)).alias("_rows")))
    named = keys.select("doc_id", F.explode(F.array_distinct("keys")).alias("key"), "_rows").where(F.col("key").isNotNull()).select("doc_id", "key.a", "key.b", "_rows")
    named = _by_id(keys, named) if by_id else named.withColumn("_documents", F.col("_rows"))
    common = written(named.groupBy("a", "b").agg(F.sum("_documents").alias("documents"), F.sum("_rows").alias("rows")).where(F.col("documents") >= min_documents))
    lines = keys.select("doc_id", "_copy", F.posexplode("keys").alias("at", "key")).where(F.col("key").isNotNull()).select("doc_id", "_copy", "at", "key.a", "key.b")
    total = keys.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    heavy = common.where(F.col("rows") > max(1, total // 1000))
    dropped = skew_join(lines, common.select("a", "b"), ["a", "b"], "left_semi", heavy)
    gone = dropped.groupBy("doc_id", "_copy").agg(F.collect_list("at").alias("gone"))
    met = texts.join(gone, texts["doc_id"].eqNullSafe(gone["doc_id"]) & (texts["_copy"] == gone["_copy"]), "left").select(texts["doc_id"], texts["text"], "gone")
    # The flags of all lines in order: sorted positions to drop, merged with the sequence of positions.
    lines_now = _lines(F.col("text"))
    flagged = met.withColumn("lines", lines_now).withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dropped", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get("lines", i)), "\n"))
    return flagged.select("doc_id", "n_lines", F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_dropped")).alias("n_dropped"), left.alias("text"))
