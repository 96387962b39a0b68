"""Removal of passages that repeat one of an earlier document, by FM-indexes of shards.

A window is `length` consecutive words. A window that also starts in a document with a smaller identifier loses its
words. The work is cut into shards by content, so that equal windows meet and nothing is compared across shards:

1. Every task tells which word pairs it has seen in one document and which in several; pairs stand for hashed positions of a bit
   map of at most 2^`pair_bits` bits, whose size does not depend on the input. A window that holds a pair of one document only
   cannot repeat and is set aside. The map can only let too many through.
2. A window's route is the smallest hash of its three-word runs. Consecutive windows of one route form a stretch of
   words, which goes to the shard of the route. Before that, each task drops stretches that it has also seen
   whole in a smaller document: their windows are covered already, and a passage that a third of all documents hold
   sends one stretch from each task.
3. Each shard builds an FM-index (wavelet tree over the sorted rotations) of its stretches and streams them through it: backward search
   gives the range of suffixes that match each window to the threshold length, and the range's smallest
   document decides. A hash of the whole window sets aside windows that no second document has before anything is
   indexed; it can only let too many through.
4. Spans of covered words go back to their documents, and words outside all spans stay.

Words are compared by 64-bit hashes, 13 of them at a time by default. The number of shards follows the size of
the texts, so that each holds about `shard_words` words.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; rows that repeat an
identifier are not smaller than one another; a null identifier is larger than any; an empty table gives no rows; other columns
are ignored; identifiers are whole numbers.
"""

from __future__ import annotations

import hashlib
import struct
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import written
from .common import Codes, id_text, text_bytes, text_parts
from .fm_index import FmIndex

LENGTH, RUN = 13, 3
NO_ID = np.iinfo(np.int64).max
_STEP = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _ahead(x: np.ndarray, by: int) -> np.ndarray:
    """Values `by` places further on; the last ones are filled up and never used."""
    out = np.empty_like(x)
    out[: len(x) - by] = x[by:]
    out[len(x) - by :] = 0
    return out


def _runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` words from each position on."""
    done, out, power = 1, hashes, np.uint64(_STEP)
    total, covered = np.zeros_like(hashes), 0
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if length & done:
                total = total + factor * (_ahead(out, covered) if covered else out)
                covered += done
                for _ in range(done):
                    factor = factor * power
            if covered == length or done > length:
                return _mixed(total)
            step = np.uint64(1)
            for _ in range(done):
                step = step * power
            out = out + step * _ahead(out, done) if done < len(out) else out
            done *= 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of the `width` values from each position on."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values, _ahead(values, done))
        done *= 2
    return np.minimum(values, _ahead(values, width - done)) if width > done else values


def _pack(*arrays: np.ndarray) -> bytes:
    import pyarrow as pa

    raw = b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) + a.tobytes() for a in arrays)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    import pyarrow as pa

    raw = pa.decompress(blob[8:], struct.unpack("<Q", blob[:8])[0], codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        kind, n = struct.unpack_from("<2sQ", raw, at)
        kind = np.dtype("<" + kind.decode())
        out.append(np.frombuffer(raw, kind, n, at + 10))
        at += 10 + n * kind.itemsize
    return out


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _pairs(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The position in the bit map of each word and the one after it."""
    with np.errstate(over="ignore"):
        return (_mixed(hashes[:-1] * np.uint64(_STEP) + hashes[1:]) >> np.uint64(64 - bits)).astype(np.int64)


def _parts(texts: list[bytes], size: int = 4_000_000) -> list[np.ndarray]:
    """Rows of consecutive texts of about so many bytes."""
    bounds = np.cumsum([len(t) for t in texts]) // size
    return [x for x in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(bounds)) + 1) if len(x)]


def shared_pairs(docs: DataFrame, bits: int, range_bits: int = 20) -> np.ndarray:
    """Bytes of the bit map of word pairs that more than one document has; 2^bits / 8 of them."""
    range_bits = min(range_bits, bits)

    def found(batches):
        import pyarrow as pa

        codes = Codes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            rows = []
            for part in _parts(texts):
                if len(codes) > 600_000:
                    codes = Codes()
                coded = [codes.of(texts[i].split()) for i in part]
                table = codes.table()
                at = [_pairs(table[c], bits) for c in coded if len(c) > 1]
                if not at:
                    continue
                _, owner = np.unique([NO_ID if ids[i] is None else ids[i] for i, c in zip(part, coded, strict=True) if len(c) > 1], return_inverse=True)
                key = np.sort((np.concatenate(at) << 24) + np.repeat(owner, [len(a) for a in at]))
                place = key >> 24
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                several = key[first] != key[np.append(first[1:], len(key)) - 1]
                place = place[first]
                for cut in np.split(np.arange(len(place)), np.flatnonzero(np.diff(place >> range_bits)) + 1):
                    inside = place[cut] & ((1 << range_bits) - 1)
                    rows.append((int(place[cut[0]] >> range_bits), _pack(np.diff(inside, prepend=0).astype("u4"), np.packbits(several[cut]))))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["range", "blob"])

    def merged(batches):
        import pyarrow as pa

        def row(number, seen):
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.packbits(seen > 1, bitorder="little").tobytes()], pa.binary())], names=["range", "bits"])

        open_range, seen = None, None
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number != open_range:
                    if seen is not None:
                        yield row(open_range, seen)
                    open_range, seen = number, np.zeros(1 << range_bits, np.uint8)
                steps, several = _unpack(blob)
                place = np.cumsum(steps, dtype=np.int64)
                seen[place] = np.minimum(seen[place] + 1 + np.unpackbits(several, count=len(place)), 2)
        if seen is not None:
            yield row(open_range, seen)

    dealt = docs.select("doc_id", "text").mapInArrow(found, "range int, blob binary").repartition("range").sortWithinPartitions("range")
    out = np.zeros(1 << max(0, bits - 3), np.uint8)
    size = max(1, (1 << range_bits) >> 3)
    for r in dealt.mapInArrow(merged, "range int, bits binary").collect():  # the whole map is 2^bits / 8 bytes
        out[r["range"] * size : (r["range"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


class _Stretches:
    """Stretches of a task's documents, sent off when enough words have come together."""

    def __init__(self, shards: int, length: int, shared: np.ndarray) -> None:
        self.shards, self.length, self.codes, self.shared = shards, length, Codes(), shared
        self.bits = int(len(shared) * 8).bit_length() - 1
        self.clear()

    def clear(self) -> None:
        self.words, self.parts = 0, []

    def add(self, ids: np.ndarray, copies: np.ndarray, texts: list[bytes]) -> None:
        if len(self.codes) > 600_000 and not self.parts:
            self.codes = Codes()
        coded = [self.codes.of(t.split()) for t in texts]
        sizes = np.array([len(c) for c in coded], np.int64)
        n = int(sizes.sum())
        if not n or sizes.max() < self.length:
            return
        words = np.concatenate(coded)
        hashes = self.codes.table()[words]
        run = min(RUN, self.length)
        routes = _least(_runs(hashes, run), self.length - run + 1)
        whole = _runs(hashes, self.length)
        ends = np.cumsum(sizes)
        at = _gather(ends - sizes, np.maximum(sizes - self.length + 1, 0))  # first words of windows
        doc = np.repeat(np.arange(len(texts)), np.maximum(sizes - self.length + 1, 0))
        pair = _pairs(hashes, self.bits)
        alone = np.concatenate([[0], np.cumsum((self.shared[pair >> 3] >> (pair & 7).astype(np.uint8) & 1) == 0)])
        can_repeat = alone[at + self.length - 1] == alone[at]
        at, doc = at[can_repeat], doc[can_repeat]
        if not len(at):
            return
        route = routes[at]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (route[1:] != route[:-1]) | (np.diff(at) != 1)])
        first = np.flatnonzero(new)
        windows = np.diff(np.append(first, len(at)))
        with np.errstate(over="ignore"):
            sums = np.concatenate([[0], np.cumsum(_mixed(whole[at]), dtype=np.uint64)]).astype(np.uint64)
            same = _mixed(sums[first + windows] - sums[first] + _mixed(whole[at[first]] ^ windows.astype(np.uint64)))
        owner = doc[first]
        start = at[first] - (ends - sizes)[owner]
        taken = _gather(at[first], windows + self.length - 1)
        self.parts.append((ids[owner], copies[owner], start, windows, (route[first] % np.uint64(self.shards)).astype(np.int64), same, words[taken]))
        self.words += len(taken) // 3

    def flush(self):
        """(shard, blob) rows: spans that are settled here, and each shard's stretches."""
        if not self.parts:
            return
        ids, copies, start, windows, shard, same, words = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        begin = np.cumsum(windows + self.length - 1) - (windows + self.length - 1)
        order = np.lexsort((ids, same))
        leads = np.concatenate([[True], same[order][1:] != same[order][:-1]])
        smallest = np.empty(len(ids), np.int64)
        smallest[order] = ids[order][np.maximum.accumulate(np.where(leads, np.arange(len(ids)), 0))]
        covered = ids > smallest
        if covered.any():
            yield int(same[0] % np.uint64(self.shards)), _pack(ids[covered], copies[covered], start[covered].astype("i4"), (start + windows + self.length - 1)[covered].astype("i4"))
        left = np.flatnonzero(~covered)
        left = left[np.argsort(shard[left], kind="stable")]
        hashes, seen, number = self.codes.table(), np.zeros(len(self.codes), bool), np.zeros(len(self.codes), np.int32)
        for part in np.split(left, np.flatnonzero(np.diff(shard[left])) + 1):
            if not len(part):
                continue
            own = words[_gather(begin[part], windows[part] + self.length - 1)]
            seen[:] = False
            seen[own] = True
            vocabulary = np.flatnonzero(seen)
            number[vocabulary] = np.arange(len(vocabulary))
            coded = number[own].astype("u2" if len(vocabulary) <= 65536 else "u4")
            yield int(shard[part[0]]), _pack(ids[part], copies[part], start[part].astype("i4"), windows[part].astype("i4"), hashes[vocabulary], coded)
        self.clear()


def covered_windows(ids: np.ndarray, windows: np.ndarray, words: np.ndarray, hashes: np.ndarray, length: int, searches: int = 200_000) -> np.ndarray:
    """For each window of a shard's stretches, in order, whether it also starts in a document with a smaller identifier.

    `words` are the stretches one after another, `hashes` those of the words' numbers.
    """
    begin = np.cumsum(windows + length - 1) - (windows + length - 1)
    at, owner = _gather(begin, windows), np.repeat(ids, windows)
    whole = _runs(hashes[words], length)[at]
    order = np.argsort(whole, kind="stable")
    leads = np.flatnonzero(np.concatenate([[True], whole[order][1:] != whole[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    sorted_owner = owner[order]
    shared = np.minimum.reduceat(sorted_owner, leads) < np.maximum.reduceat(sorted_owner, leads) if len(leads) else np.zeros(0, bool)
    group = np.repeat(np.arange(len(leads)), np.diff(np.append(leads, len(order))))
    open_window = np.zeros(len(at), bool)
    open_window[order] = shared[group]
    out = np.zeros(len(at), bool)
    if not open_window.any():
        return out
    # Index the stretches that hold such a window; search one window of each hash and compare the others with it.
    stretch = np.repeat(np.arange(len(ids)), windows)
    kept = np.unique(stretch[open_window])
    sizes = windows[kept] + length - 1
    gap = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
    used, text_words = np.unique(words[_gather(begin[kept], sizes)], return_inverse=True)
    text[_gather(gap + 1, sizes)] = text_words + 1
    place = np.full(len(ids), -1, np.int64)
    place[kept] = gap + 1
    asked = np.flatnonzero(open_window)
    ends = place[stretch[asked]] + (at[asked] - begin[stretch[asked]]) + length - 1
    document = np.full(len(text), NO_ID, np.int64)
    document[_gather(gap + 1, sizes)] = np.repeat(ids[kept], sizes)
    index = FmIndex(text, length)
    by_hash = whole[asked]
    _, one, which = np.unique(by_hash, return_index=True, return_inverse=True)
    low, high = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
    for i in range(0, len(one), searches):
        low[i : i + searches], high[i : i + searches] = index.search(ends[one[i : i + searches]], text, length)
    in_order = document[index.order]
    firsts = np.flatnonzero(index.group == np.arange(index.size))
    least = np.minimum.reduceat(in_order, firsts)
    # A range is a whole group of equal prefixes.
    smallest = least[np.searchsorted(firsts, low)]
    rows = np.empty(index.size, np.int64)
    rows[index.order] = np.arange(index.size)
    inside = rows[ends - length + 1]
    true_match = (inside >= low[which]) & (inside < high[which])
    out[asked] = true_match & (smallest[which] < owner[asked])
    lost = np.flatnonzero(~true_match)
    if len(lost):  # two windows of one hash that differ: searched on their own
        l, h = index.search(ends[lost], text, length)
        out[asked[lost]] = least[np.searchsorted(firsts, l)] < owner[asked[lost]]
    return out


def _spans(blobs: list[list[np.ndarray]], length: int):
    """(ids, copies, begin, end) of covered words in a shard."""
    sizes = [len(b[4]) for b in blobs]
    shift = np.cumsum([0, *sizes])
    ids, copies, start, windows = (np.concatenate([b[i] for b in blobs]).astype(np.int64) for i in range(4))
    hashes, number = np.unique(np.concatenate([b[4] for b in blobs]), return_inverse=True)
    words = np.concatenate([number[shift[i] : shift[i + 1]][b[5]] for i, b in enumerate(blobs)])
    covered = covered_windows(ids, windows, words, hashes, length)
    stretch = np.repeat(np.arange(len(ids)), windows)
    position = _gather(start, windows)
    hit = np.flatnonzero(covered)
    if not len(hit):
        return None
    new = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(stretch[hit]) != 0)])
    first = hit[new]
    last = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
    return ids[stretch[first]], copies[stretch[first]], position[first].astype("i4"), (position[last] + length).astype("i4")


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard_words: int = 2_000_000, task_words: int = 1_500_000, pair_bits: int = 28) -> DataFrame:
    """(doc_id, copy, begin, end): words of (doc_id long, copy long, text string) that repeat a smaller document's; spans may overlap."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(4 * partitions, size // 2 // shard_words)  # stretches overlap: about half a word for each byte
    partitions = max(partitions, shards // 4)
    shared = spark.sparkContext.broadcast(shared_pairs(docs, min(pair_bits, max(16, int(size).bit_length()))))  # 2^pair_bits bits at most

    def stretches(batches):
        import pyarrow as pa

        def rows(made):
            found = list(made)
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["shard", "blob"])

        state = _Stretches(shards, length, shared.value)
        seen: set[tuple[int, int]] = set()  # of the rows of one task: those that repeat both say nothing new
        for batch in (part for whole in batches for part in text_parts(whole, 2)):
            ids = np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            copies, texts = batch.column(1).to_numpy(), text_bytes(batch.column(2))
            fresh = [key not in seen and not seen.add(key) for key in zip(ids.tolist(), copies.tolist(), strict=True)]
            ids, copies, texts = ids[fresh], copies[fresh], list(compress(texts, fresh))
            for part in _parts(texts):
                state.add(ids[part], copies[part], texts[part[0] : part[-1] + 1])
                if state.words >= task_words:
                    yield rows(state.flush())
        yield rows(state.flush())

    def spans(batches):
        import pyarrow as pa

        def rows(arrays):
            ids, copies, begin, end = (np.asarray(a) for a in arrays)
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), *map(pa.array, (copies, begin, end))], names=["doc_id", "copy", "begin", "end"])

        open_shard, held = None, []
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                arrays = _unpack(blob)
                if len(arrays) == 4:
                    yield rows(arrays)
                    continue
                if shard != open_shard:
                    if held and (found := _spans(held, length)):
                        yield rows(found)
                    open_shard, held = shard, []
                held.append(arrays)
        if held and (found := _spans(held, length)):
            yield rows(found)

    routed = docs.mapInArrow(stretches, "shard int, blob binary").repartition(partitions, "shard").sortWithinPartitions("shard")
    return routed.mapInArrow(spans, "doc_id long, copy long, begin int, end int")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = True, **options) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text (words joined by one space)."""
    texts = id_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
    found = written(repeated_spans(texts, length, **options))
    # Rows that repeat both identifier and text have the same spans, once for each task that read one.
    spans = found.groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).agg(F.collect_set(F.struct("begin", "end")).alias("span"))
    spans = spans.select("_id", "_copy", F.col("span.begin").alias("begin"), F.col("span.end").alias("end"))
    met = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "left").select("doc_id", "text", "begin", "end")

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            total, removed, digests, left = [], [], [], []
            for text, begin, end in zip(text_bytes(batch.column(1)), batch.column(2), batch.column(3), strict=True):
                words = text.split()
                total.append(len(words))
                removed.append(0)
                if begin.is_valid:
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, begin.values.to_numpy(), 1)
                    np.add.at(edge, end.values.to_numpy(), -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    removed[-1] = int(len(words) - stays.sum())
                    words = compress(words, stays.tolist())
                text = b" ".join(words)
                digests.append(hashlib.sha256(text).hexdigest())
                left.append(text if with_text else None)
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), *[pa.array(left, pa.binary()).cast(pa.string())] * with_text]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["text"] * with_text])

    return met.mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
