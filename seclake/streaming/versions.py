"""What is known of each path of a stream: the time and hash of its newest version, kept as keyed state.

Versions are scanned where they arrive, and what counts of a version's hits is chosen there, too. What moves to the state of a path is one row
for each version, with its hits as one value that the state does not look into, never a text; of the versions of a path the newest counts, and
one whose hash is known already says nothing new. What a pattern's number tells is looked up when the state has spoken.

A call of the state costs as much as a hundred rows, and a key takes several of them, so that the paths are keyed by buckets: there is a call for
each bucket that a trigger touches, not for each path.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.matching import FILE, pattern_hits, pattern_table, reminder_score
from ..operators.taint import flow_analysis
from ..plans.scan import enabled_rules
from ..rules import Rule
from ..rules.model import ADVISORY, REMINDER
from ..sources.files import NO_LIMITS, Limits, content_hash, scannable

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What is moved of a hit; `told` is JSON. A row without a number stands for the version itself, so that a version without findings is heard of, too.
_HIT = "line int, col int, number int, severity int, pattern string, told string"
_VERSION = "repo string, path string, language string, ts long, content_hash string"
_MOVED = ["repo", "path", "language", "ts", "content_hash", "found"]
#: A matched text may be as long as a text can be.
_JSON = {"maxStringLen": str((1 << 31) - 1)}


def chosen(version: np.ndarray, hits: dict[str, np.ndarray], reminder_lines: int | None = None) -> np.ndarray:
    """Which hits count: of each version the first pattern of each code and line, every hit of the flow analysis, and each reminder once.

    `version` numbers the versions of the hits; the hits have line, number, code and told as numbers, and whether and how well they remind.
    """
    def firsts(rows: np.ndarray, order: Sequence[np.ndarray], apart: int) -> np.ndarray:
        """Of `rows`, the first of each group by the first `apart` keys, in the order of all of them."""
        rows = rows[np.lexsort([k[rows] for k in reversed(order)])]
        return rows[_begins([k[rows] for k in order[:apart]])]

    line, number, code, told, reminds, score = (hits[k] for k in ("line", "number", "code", "told", "reminds", "score"))
    first = firsts(np.arange(len(version)), [version, code, line, told, number], 4)
    own = first[reminds[first]]  # by version, code and line
    if reminder_lines is not None and len(own):
        begins = _begins([version[own], code[own]])
        own = own[np.arange(len(own)) - np.maximum.accumulate(np.where(begins, np.arange(len(own)), 0)) < reminder_lines]
    rows = np.concatenate([first[~reminds[first]], firsts(own, [version, code, -score, line], 2)])
    return rows[np.lexsort((number[rows], line[rows], version[rows]))]


def _begins(keys: Sequence[np.ndarray]) -> np.ndarray:
    """Where a group begins in sorted rows."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def one_row_each(reminder_lines: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Make one row of a version and its hits, which follow the version's marker. A version is held until the next one begins."""
    hit = pa.schema([("line", pa.int32()), ("col", pa.int32()), ("number", pa.int32()), ("severity", pa.int32()), ("pattern", pa.string()), ("told", pa.string())])
    version = pa.schema([("repo", pa.string()), ("path", pa.string()), ("language", pa.string()), ("ts", pa.int64()), ("content_hash", pa.string())])

    def packed(rows: pa.Table) -> pa.RecordBatch:
        numbers = lambda c: rows.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        names = lambda c: rows.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        begins = rows.column("code").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(~begins)
        fields = {"line": numbers("line"), "number": numbers("number"), "code": names("code"), "told": names("told"), "reminds": numbers("reminds") == 1, "score": numbers("score")}
        owner = np.cumsum(begins)
        kept = at[chosen(owner[at], {k: v[at] for k, v in fields.items()}, reminder_lines)]
        hits = rows.select(hit.names).take(pa.array(kept)).cast(hit).combine_chunks()
        ends = np.searchsorted(owner[kept], np.arange(1, int(begins.sum()) + 1), "right")
        found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays([hits.column(c).combine_chunks() for c in hit.names], fields=list(hit)))
        own = rows.select(version.names).filter(pa.array(begins)).cast(version).combine_chunks()
        return pa.RecordBatch.from_arrays([*(own.column(c).combine_chunks() for c in version.names), found], names=[*version.names, "found"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            begins = np.flatnonzero(batch.column("code").is_null().to_numpy(zero_copy_only=False))
            if not len(begins):
                held.append(batch)
                continue
            last = int(begins[-1])
            done = pa.Table.from_batches([*held, batch.slice(0, last)], batch.schema)
            held = [batch.slice(last)]
            if done.num_rows:
                yield packed(done)
        if held:
            yield packed(pa.Table.from_batches(held))

    return pack


class NewestVersions(StatefulProcessor):
    """Passes on the newest version of each path of a bucket if its hash is new; the state of a path that is quiet for `keep_ms` goes.

    The state of a bucket is a JSON list of (repo, path, ts, hash, time until it is kept).
    """

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "versions string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        newest: dict[tuple, Row] = {}
        for r in rows:
            other = newest.get((r.repo, r.path))
            if other is None or (r.ts, r.content_hash or "") > (other.ts, other.content_hash or ""):
                newest[r.repo, r.path] = r
        now = timerValues.getCurrentProcessingTimeInMs() if self.keep_ms else 0
        known = {(repo, path): (ts, content_hash, until) for repo, path, ts, content_hash, until in json.loads(self.known.get()[0])} if self.known.exists() else {}
        if self.keep_ms:
            known = {k: v for k, v in known.items() if v[2] > now}
        changed, told, until = False, [], now + self.keep_ms if self.keep_ms else None
        for at, r in newest.items():
            ts, content_hash, _ = known.get(at, (None, None, None))
            if at in known and (r.ts < ts or (r.ts, r.content_hash) == (ts, content_hash)):
                continue
            if at not in known or r.content_hash != content_hash:
                told.append(r)
            known[at] = (r.ts, r.content_hash, until)
            changed = True
        if changed:
            self.known.update((json.dumps([[*k, *v] for k, v in known.items()]),))
        yield from (Row(**{c: r[c] for c in _MOVED}) for r in told)

    def close(self) -> None:
        pass


def with_keyed_state(spark: SparkSession, time_to_live: bool = False) -> None:
    """Keyed state needs the RocksDB store; the session uses it from now on.

    With a time to live, batches without data are switched off: it would ask for one after the other, so that a run over what is
    there would never end. What has outlived its time goes with the next batch of data.
    """
    spark.conf.set(_PROVIDER, _ROCKSDB)
    if time_to_live:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def updates(versions: DataFrame, rules: Sequence[Rule] | None = None, taint: bool = True, limits: Limits = NO_LIMITS, keep_ms: int | None = None,
            buckets: int = 1 << 15) -> DataFrame:
    """Findings of the versions (repo, path, language, content, ts long) that are newest and changed, after a row for each such version itself.

    A trigger reads and stores what is known of the paths of each bucket that it touches. The number of buckets stays with the checkpoint.
    """
    with_keyed_state(versions.sparkSession, bool(keep_ms))
    files = versions.select(*FILE, "content", F.col("ts").cast("long").alias("ts"), content_hash(F.col("content")).alias("content_hash"))
    if limits.file_bytes or limits.skip_generated or limits.skip_minified:
        files = files.where(scannable(F.col("path"), F.col("content"), limits))
    kept, companion = [r for r in enabled_rules(rules) if r.kind != ADVISORY], flow_analysis(limits) if taint else None
    hits = pattern_hits(files, kept, line_limit=limits.line_chars, companion=companion, markers=True)
    told = F.to_json("told") if taint else F.lit(None).cast("string")
    reminds = F.coalesce(F.col("kind") == REMINDER, F.lit(False))
    scanned = hits.select(
        *FILE, "ts", "content_hash", "line", "col", "code", "severity", "pattern", "number", told.alias("told"),
        reminds.cast("int").alias("reminds"), F.when(reminds, reminder_score(F.col("text"))).otherwise(0).alias("score"),
    )
    packed = scanned.mapInArrow(one_row_each(limits.reminder_lines), f"{_VERSION}, found array<struct<{_HIT}>>")
    moved = packed.withColumn("found", F.when(F.size("found") > 0, F.to_json("found")))
    keyed = moved.withColumn("bucket", F.pmod(F.xxhash64("repo", "path"), F.lit(buckets)))
    newest = keyed.groupBy("bucket").transformWithState(NewestVersions(keep_ms), f"{_VERSION}, found string", "Update", "ProcessingTime" if keep_ms else "None")
    itself = F.from_json(F.lit("[{}]"), f"array<struct<{_HIT}>>")
    found = F.coalesce(F.from_json("found", f"array<struct<{_HIT}>>", _JSON), F.array())
    rows = newest.select(*FILE, "ts", "content_hash", F.explode(F.concat(itself, found)).alias("hit")).select(*FILE, "ts", "content_hash", "hit.*")
    table = pattern_table(files.sparkSession, kept, companion).select("number", "code", "category", "message", "suggestion")
    rows = rows.join(F.broadcast(table), "number", "left")
    if companion:
        told = F.from_json("told", "name string, source_line int, label string", _JSON)
        rows = rows.withColumn("message", F.when(F.col("told").isNotNull(), companion.message(F.col("message"), told)).otherwise(F.col("message")))
    return rows.select(*FILE, "line", "col", "code", "severity", "category", "message", "suggestion", "pattern", "ts", "content_hash")
