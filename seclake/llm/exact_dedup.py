"""Exact deduplication by a tree-merge of digest runs.

Rows are dealt to runs by a hash of their identifier. Each run is reduced to one entry for each digest: the
identifier to keep and the number of rows. Then runs meet in binomial rounds: in each, `fan_in` neighbouring
runs are merged into one and equal digests of them become one entry, until one run, spread over the cluster by
digest, is left. Hot digests shrink to one entry for each run before anything is shuffled, so no
round moves more than one entry of a digest from each task. Entries are equal only where the SHA-256, a second hash
and the length of the normalised text all agree; that is the check made at every level.

Defined results: null texts count as empty; a null identifier is kept only if its group has no other; repeated rows
each get their row back, all of them marked kept if they carry the kept identifier; an empty table gives no
rows; other columns are ignored. Of the rows that `without_copies` is given, one is left of each group, also where rows repeat
the kept identifier or have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import written
from .common import ascii_lower, id_text, skew_join, text_key, without_rows

DIGEST = ["text_sha256", "_check", "_length"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, copy, text_sha256, second hash, length), all but the copy (the text's key) of the texts with A-Z lower-cased. Texts are read and hashed once."""
    text = id_text(docs, id_col, text_col).withColumn("copy", text_key(F.col("text"))).withColumn("text", ascii_lower(F.col("text")))
    return text.select("doc_id", "copy", F.sha2("text", 256).alias("text_sha256"), F.xxhash64("text").alias("_check"), F.octet_length("text").alias("_length"))


def merged_runs(rows: DataFrame, runs: int = 64, fan_in: int = 8, keep: str = "max") -> DataFrame:
    """One entry for each digest: keep_id and group_size, merged over rounds of runs."""
    pick = {"max": F.max, "min": F.min}[keep]
    level = rows.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(runs)).alias("_run"), *DIGEST).agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    while runs > 1:
        runs = -(-runs // fan_in)
        level = level.groupBy(F.floor(F.col("_run") / fan_in).alias("_run"), *DIGEST).agg(pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return level.drop("_run")


def _grouped(docs: DataFrame, id_col: str, text_col: str, keep: str, runs: int, fan_in: int) -> DataFrame:
    """The digests of all rows with the keep_id and group_size of their group."""
    rows = written(digests(docs, id_col, text_col))
    groups = written(merged_runs(rows, runs, fan_in, keep))
    # Digests of more than a thousandth of the rows: fewer than a thousand.
    heavy = groups.where(F.col("group_size") > F.greatest(F.lit(1), F.lit(rows.count()) / 1000))
    return skew_join(rows, groups, DIGEST, "inner", heavy).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", runs: int = 64, fan_in: int = 8) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _grouped(docs, id_col, text_col, keep, runs, fan_in).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of `docs` that are kept, one of each group, with all their columns."""
    grouped = _grouped(docs, id_col, text_col, keep, 64, 8).where(F.col("group_size") > 1)
    keys = written(grouped.groupBy("doc_id", "copy", *DIGEST, "kept").agg(F.count(F.lit(1)).alias("n")))
    # Of a group's rows with the kept identifier, the one with the least copy.
    first = keys.where("kept").groupBy(*DIGEST).agg(F.min("copy").alias("first"), F.count(F.lit(1)).alias("copies"))
    more = written(first.where(F.col("copies") > 1))
    others = keys.where("kept").join(more, DIGEST).where(F.col("copy") != F.col("first"))
    dropped = keys.where(~F.col("kept")).select("doc_id", "copy").unionByName(others.select("doc_id", "copy"))
    repeated = keys.where(F.col("kept") & (F.col("n") > 1)).select("doc_id", "copy")
    return without_rows(docs, dropped, repeated, id_col, text_col)
