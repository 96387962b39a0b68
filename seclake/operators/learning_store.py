"""What past actions say, kept up to date by batches instead of read from the whole log.

A batch of actions is reduced to partial sums by day, rule, language and path bucket, as many rows as these have whatever the log
holds. Partial sums merge in any order, so late actions are a batch like any other. A correction sends all actions of some
days again; it replaces what was there of these days, as earliest and latest times cannot be taken back one by one. A batch
counts once its number is noted, and does nothing when it is sent again; `compact` merges all partial sums so far.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import path_bucket
from .learning import rule_stats

GRAIN = ["day", "code", "language", "bucket"]
_COUNTS = ["detections", "fps", "fixed", "ignored", "verified", "fix_failed", "resolution_ms", "resolutions"]
_SCHEMA = "day date, code string, language string, bucket string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", first_seen_at timestamp, last_fired_at timestamp, batch long"


def partial_sums(actions: DataFrame) -> DataFrame:
    """The sums of an action log by day, rule, language and path bucket."""
    placed = actions.withColumn("day", F.to_date("ts")).withColumn("bucket", path_bucket(F.col("path"))).withColumn("ts", F.col("ts").cast("timestamp"))
    return rule_stats(placed, tuple(GRAIN)).select(*GRAIN, *[F.col(c).cast("long").alias(c) for c in _COUNTS], "first_seen_at", "last_fired_at")


def merged(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of sums; by (`code`,) these are the rule statistics."""
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _COUNTS], F.min("first_seen_at").alias("first_seen_at"), F.max("last_fired_at").alias("last_fired_at"))


def language_stats_of(sums: DataFrame) -> DataFrame:
    by = merged(sums, ["code", "language"])
    return by.select("code", "language", F.col("detections").alias("lang_detections"), F.col("fps").alias("lang_fps"), (F.col("fixed") + F.col("verified")).alias("lang_fixed"))


def bucket_stats_of(sums: DataFrame) -> DataFrame:
    return merged(sums, ["code", "bucket"]).select("code", "bucket", F.col("detections").alias("bucket_detections"), F.col("fps").alias("bucket_fps"))


class LearningStore:
    """A folder of partial sums by batch."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _noted(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def batches(self) -> list[int]:
        return sorted({r.batch for r in self._noted("commits", "batch long").collect()})

    def _upto(self) -> int | None:
        return max((r.batch for r in self._noted("compactions", "batch long").collect()), default=None)

    def sums(self) -> DataFrame:
        """Partial sums of all batches that count, without what later corrections replaced."""
        upto = self._upto()
        parts = [f"upto-{upto}"] if upto is not None else []
        parts += [f"batch-{n}" for n in self.batches() if upto is None or n > upto]
        if not parts:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(f"{_SCHEMA}, part string").option("basePath", f"{self.folder}/sums").parquet(*[f"{self.folder}/sums/part={p}" for p in parts])
        committed = [n for n in self.batches() if upto is None or n > upto]
        replaced = self._noted("replaced", "day date, batch long").where(F.col("batch").isin(committed)).groupBy("day").agg(F.max("batch").alias("_since"))
        return rows.join(replaced, "day", "left").where(F.col("_since").isNull() | (F.col("batch") >= F.col("_since"))).drop("part", "_since")

    def add(self, batch: int, actions: DataFrame, corrects: bool = False) -> bool:
        """Merge a batch of actions; with `corrects` they are all actions of the days that they name. False if the batch counts already."""
        if batch in (known := self.batches()):
            return False
        if known and batch < known[-1]:
            raise ValueError(f"batch {batch} comes after {known[-1]}")
        path = f"{self.folder}/sums/part=batch-{batch}"
        partial_sums(actions).withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(path)
        if corrects:
            days = self.spark.read.schema(_SCHEMA).parquet(path).select("day", "batch").distinct()
            days.write.mode("append").parquet(f"{self.folder}/replaced")
        self.spark.range(1).select(F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(f"{self.folder}/commits")
        return True

    def compact(self) -> None:
        """Merge the partial sums of all batches so far."""
        done = self.batches()
        if done and done[-1] != self._upto():
            whole = merged(self.sums(), GRAIN).withColumn("batch", F.lit(done[-1]).cast("long"))
            whole.write.mode("overwrite").parquet(f"{self.folder}/sums/part=upto-{done[-1]}")
            self.spark.range(1).select(F.lit(done[-1]).cast("long").alias("batch")).write.mode("append").parquet(f"{self.folder}/compactions")
