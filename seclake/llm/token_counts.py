"""Token counts as rollups that are maintained by signed changes.

A store is a folder with a `ledger` (what each document counts for now), signed `deltas` (documents and tokens by source,
language and tokenizer version), and the numbers of the batches that are committed. A document is known by its identifier, the hash of
its text and the tokenizer version; the ledger holds the rows that it stands for: as many as the table repeats, each group of equal ones
once, with their number. A batch of changes

* inserts a document's rows, deletes them, or revises them (new counts, sources or languages); what the last `seq` of
  the batch says of a document replaces what was there;
* is turned into signed deltas: minus the old rows, plus the new. Only the buckets of the ledger that hold a changed document
  are read, and of them only the changed documents;
* is written as ledger and deltas of its number, after which its number is committed.

Readers only see committed batches, so a batch that failed half-way is overwritten when it is repeated, and one that
has been committed does nothing when it is repeated. Totals are the sums of the committed deltas; `compact` replaces
deltas and ledger so far by their sums and newest rows, from which later reads start. Deleting a document that is not there changes nothing.

Defined results: every row counts, those that repeat identifier and text and those without an identifier too, which are known by
their text; null texts have no tokens; null sources, languages and versions are groups of their own; identifiers of any kind are
kept as text; an empty batch commits and changes nothing; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import named, text_bytes, text_key, text_parts
from .tokens import encoder

KEYS = ["source", "lang", "version"]
DOCUMENT = ["doc_id", "copy", "version"]
_LEDGER = "doc_id string, copy long, version string, source string, lang string, n_tokens long, rows long, batch long, bucket int"
_DELTAS = "source string, lang string, version string, documents long, tokens long, batch long"


def token_counts(docs: DataFrame, tokenizers: dict[str, str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, copy, source, lang, version, n_tokens): a row for each document and tokenizer version; the copy is the text's hash. A
    tokenizer is a vocabulary file, or `words` for blank-separated words. Texts are read once for all versions.
    """
    texts = named(docs, doc_id=id_col, text=text_col, source=source_col, lang=lang_col)
    texts = texts.select("doc_id", text_key(F.col("text")).alias("copy"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    versions = sorted(tokenizers.items())

    def counted(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in text_parts(whole, 2)):
            texts = text_bytes(batch.column(2))
            for version, name in versions:
                if name == "words":
                    counts = [len(t.split()) for t in texts]
                else:
                    encode = encoder(name).encode
                    counts = [len(encode(t)) // 4 for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array([version] * len(texts), pa.string()), pa.array(counts, pa.int64())],
                    names=["doc_id", "copy", *KEYS, "n_tokens"],
                )

    return texts.mapInArrow(counted, f"doc_id {kind}, copy long, source string, lang string, version string, n_tokens long")


def _same(left: DataFrame, right: DataFrame) -> Column:
    return reduce(Column.__and__, [left[c].eqNullSafe(right[c]) for c in DOCUMENT])


class CountStore:
    """A folder of counts that changes are committed to, one numbered batch after another."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _numbers(self, table: str) -> list[int]:
        """The numbers that a table of one column lists, of which a row is written when everything else is."""
        try:
            return sorted({r.batch for r in self.spark.read.schema("batch long").parquet(f"{self.folder}/{table}").collect()})
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def _note(self, table: str, batch: int) -> None:
        self.spark.range(1).coalesce(1).select(F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(f"{self.folder}/{table}")

    def committed(self) -> list[int]:
        return self._numbers("commits")

    def _compacted(self) -> int | None:
        """The last batch that compacted sums and rows hold."""
        return max(self._numbers("compactions"), default=None)

    def _read(self, table: str, schema: str, upto: int | None, batches: list[int]) -> DataFrame:
        """The compacted part of a table and the given batches after it."""
        parts = [f"upto-{upto}"] if upto is not None else []
        parts += [f"batch-{n}" for n in batches if upto is None or n > upto]
        if not parts:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(f"{schema}, part string").option("basePath", f"{self.folder}/{table}")
        return reader.parquet(*[f"{self.folder}/{table}/part={p}" for p in parts]).drop("part")

    def _newest(self, rows: DataFrame) -> DataFrame:
        """Of ledger rows those of the last batch that speaks of their document, without the marks of deleted ones."""
        last = F.max("batch").over(Window.partitionBy(*DOCUMENT))
        return rows.withColumn("_last", last).where((F.col("batch") == F.col("_last")) & (F.col("rows") > 0)).drop("_last")

    def ledger(self) -> DataFrame:
        """What each document counts for: doc_id, copy, version, source, lang, n_tokens, rows."""
        rows = self._read("ledger", _LEDGER, self._compacted(), self.committed())
        return self._newest(rows).drop("batch", "bucket")

    def totals(self) -> DataFrame:
        """documents and tokens by source, language and tokenizer version."""
        parts = self._read("deltas", _DELTAS, self._compacted(), self.committed())
        sums = parts.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where((F.col("documents") != 0) | (F.col("tokens") != 0))

    def _entries(self, changes: DataFrame, batch: int) -> DataFrame:
        """Ledger rows that say what a batch makes of its documents."""
        copy = F.col("copy").cast("long") if "copy" in changes.columns else F.lit(0).cast("long")
        given = changes.select(
            F.col("doc_id").cast("string").alias("doc_id"), copy.alias("copy"), F.col("version").cast("string").alias("version"), F.col("source").cast("string").alias("source"),
            F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"),
            F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.coalesce(F.col("op") != "delete", F.lit(True)).alias("live"),
        )
        # Equal rows become one before anything is moved by document, of which a third of all rows may be one.
        rows = given.groupBy(*DOCUMENT, "source", "lang", "n_tokens", "seq", "live").agg(F.count(F.lit(1)).alias("rows"))
        own = Window.partitionBy(*DOCUMENT)
        last = rows.withColumn("_last", F.max("seq").over(own)).where(F.col("seq") == F.col("_last"))
        ranked = last.withColumn("_live", F.max("live").over(own)).withColumn("_first", F.row_number().over(own.orderBy("source", "lang", "n_tokens")))
        kept = ranked.where(F.col("live") | ~F.col("_live") & (F.col("_first") == 1))
        gone = lambda c: F.when(F.col("live"), F.col(c)).alias(c)
        return kept.select(
            *DOCUMENT, gone("source"), gone("lang"), F.when(F.col("live"), F.col("n_tokens")).otherwise(0).alias("n_tokens"), F.when(F.col("live"), F.col("rows")).otherwise(0).alias("rows"),
            F.lit(batch).cast("long").alias("batch"), F.pmod(F.xxhash64("doc_id", "copy"), F.lit(self.buckets)).cast("int").alias("bucket"),
        )

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply (op, seq, doc_id, copy, source, lang, version, n_tokens) once; op is insert, delete or revise. False if this batch is there already.

        Batches must be applied in the order of their numbers. Without a column `copy` a document is known by its identifier alone.
        """
        done, upto = self.committed(), self._compacted()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]}")
        path = f"{self.folder}/ledger/part=batch-{batch}"
        self._entries(changes, batch).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        entries = self.spark.read.schema(_LEDGER).parquet(path)
        deltas = self._signed(entries, 1)
        touched = [r.bucket for r in entries.select("bucket").distinct().collect()]  # as many as there are buckets at most
        if done and touched:
            before = self._read("ledger", _LEDGER, upto, done).where(F.col("bucket").isin(touched))
            keys = entries.select(*DOCUMENT).distinct()
            deltas = deltas.unionByName(self._signed(self._newest(before.join(keys, _same(before, keys), "left_semi")), -1))
        sums = deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        sums.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/deltas/part=batch-{batch}")
        self._note("commits", batch)
        return True

    @staticmethod
    def _signed(entries: DataFrame, sign: int) -> DataFrame:
        return entries.select(*KEYS, (sign * F.col("rows")).alias("documents"), (sign * F.col("rows") * F.col("n_tokens")).alias("tokens"))

    def compact(self) -> None:
        """Write the sums of all committed deltas and the newest rows of the ledger, from which later reads start."""
        done, upto = self.committed(), self._compacted()
        if not done or done[-1] == upto:
            return
        last = F.lit(done[-1]).cast("long")
        self.totals().withColumn("batch", last).write.mode("overwrite").parquet(f"{self.folder}/deltas/part=upto-{done[-1]}")
        rows = self._newest(self._read("ledger", _LEDGER, upto, done))
        rows.withColumn("batch", last).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/ledger/part=upto-{done[-1]}")
        self._note("compactions", done[-1])


def changes(counts: DataFrame, op: str, seq: int = 0) -> DataFrame:
    """Rows of token_counts, or of a ledger, as changes of one kind."""
    given = counts.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))) if "rows" in counts.columns else counts
    return given.select(F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"), F.col("doc_id").cast("string").alias("doc_id"), "copy", *KEYS, "n_tokens")
