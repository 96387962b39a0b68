"""Best-fit packing of documents into sequences by linear grouping.

Every document becomes pieces of at most `capacity` tokens. The packing is planned on the histogram of piece
lengths, which has at most `capacity` rows whatever the corpus holds: large lengths are sorted, cut into
groups of equal cardinality and rounded up to the longest of their group; a linear program over
configurations of these few sizes (columns made by a knapsack) is rounded down; the slots take the actual
lengths; what is left over and the small lengths go best-fit into the room that remains. The plan says for
the k-th piece of each length where it goes, and the pieces find their k by a count within salted buckets.

Defined results: null and empty texts are one piece that holds the end id; repeated rows are packed as often as
they occur; an empty table gives no rows; columns other than the two named ones are ignored; texts of any
length are encoded whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.workspace import written
from .common import id_text, text_bytes, text_parts
from .tokens import encoder

CAPACITY, END_ID = 4096, 1
TOKENIZER = "word_bpe_49k.json"
#: Which lengths are grouped (those over 1 / n of the capacity) and into how many groups.
TRIALS = ((3, 256), (3, 512), (4, 256), (8, 32))
Run = tuple[int, int, list[tuple[int, int]]]


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY,
        end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    table = id_text(docs, id_col, text_col)
    kind = table.schema["doc_id"].dataType.simpleString()

    def pieces(batches):
        import pyarrow as pa

        encode, end = encoder(tokenizer).encode, int(end_id).to_bytes(4, "little")
        for batch in (part for whole in batches for part in text_parts(whole, 1)):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(text_bytes(batch.column(1))):
                data = encode(text) + end
                for number, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append(row)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype("i4"))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return table.mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def configurations(sizes: list[int], demands: list[int], capacity: int, steps: int = 3000) -> list[tuple[list[int], float]]:
    """Fill patterns and how often to use each: the linear program of the cutting-stock problem.

    A pattern counts copies of each size. Each step prices the sizes by the dual values and lets the best pattern
    that a knapsack finds enter the basis; it ends when none is worth more than the sequence it takes.
    """
    k = len(sizes)
    patterns = np.diag([capacity // s for s in sizes]).astype(float)
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    used = inverse @ np.array(demands, float)
    layers = capacity // min(sizes)
    for _ in range(steps):
        prices = inverse.sum(axis=0)
        pattern, worth = _knapsack(sizes, prices, capacity, layers)
        if worth <= 1 + 1e-9:
            break
        direction = inverse @ pattern
        usable = direction > 1e-9
        if not usable.any():
            break
        ratio = np.full(k, np.inf)
        ratio[usable] = used[usable] / direction[usable]
        out = int(ratio.argmin())
        step = max(0.0, ratio[out])
        used = np.maximum(used - step * direction, 0)
        used[out] = step
        patterns[:, out] = pattern
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
    return [([int(c) for c in patterns[:, i]], float(used[i])) for i in range(k)]


def _knapsack(sizes: list[int], prices: np.ndarray, capacity: int, layers: int) -> tuple[np.ndarray, float]:
    """The dearest multiset of sizes within the capacity, by the number of its members."""
    best, picks = np.zeros(capacity + 1), []
    for _ in range(layers):
        now, pick = best.copy(), np.full(capacity + 1, -1, np.int16)
        for i, (size, price) in enumerate(zip(sizes, prices, strict=True)):
            if price > 1e-12:
                offer = best[: capacity + 1 - size] + price
                better = offer > now[size:] + 1e-12
                now[size:][better] = offer[better]
                pick[size:][better] = i
        picks.append(pick)
        if (pick < 0).all():
            break
        best = now
    pattern, left = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[left] >= 0:
            pattern[pick[left]] += 1
            left -= sizes[pick[left]]
    return pattern, float(best[capacity])


class _Bins:
    """Runs of bins filled alike, found by the room they have left."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.count = capacity, 0
        self.done: list[Run] = []
        self.rooms: list[int] = []
        self.by_room: dict[int, list[Run]] = defaultdict(list)

    def put(self, run: Run, room: int) -> None:
        if room <= 0:
            self.done.append(run)
            return
        if not self.by_room[room]:
            insort(self.rooms, room)
        self.by_room[room].append(run)

    def open(self, bins: int, content: list[tuple[int, int]]) -> None:
        if bins:
            self.put((self.count, bins, content), self.capacity - sum(size * copies for size, copies in content))
            self.count += bins

    def fit(self, size: int, count: int) -> None:
        """Place items of one size one after another in the fullest bin that still takes them."""
        while count:
            at = bisect_left(self.rooms, size)
            if at == len(self.rooms):
                each = self.capacity // size
                bins = count // each
                self.open(bins, [(size, each)])
                if count % each:
                    self.open(1, [(size, count % each)])
                return
            room = self.rooms[at]
            first, bins, content = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms.pop(at)
            each = room // size
            full = min(bins, count // each)
            if full:
                self.put((first, full, [*content, (size, each)]), room - size * each)
                count -= full * each
                first, bins = first + full, bins - full
            if bins and count and count < each:
                self.put((first, 1, [*content, (size, count)]), room - size * count)
                first, bins, count = first + 1, bins - 1, 0
            if bins:
                self.put((first, bins, content), room)

    def runs(self) -> list[Run]:
        return self.done + [run for room in self.rooms for run in self.by_room[room]]


def _grouped(large: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """Cut lengths, longest first, into groups of equal cardinality; a length may be in two of them."""
    total = sum(n for _, n in large)
    each = -(-total // max(1, min(groups, total)))
    out: list[list[list[int]]] = [[]]
    room = each
    for size, n in large:
        while n:
            if not room:
                out.append([])
                room = each
            take = min(n, room)
            out[-1].append([size, take])
            n, room = n - take, room - take
    return out


def _take(queue: list[list[int]], n: int) -> list[tuple[int, int]]:
    """The next n items of a group as (length, count); (0, count) once it is exhausted."""
    out = []
    while n:
        if not queue:
            out.append((0, n))
            break
        size, there = queue[0]
        took = min(n, there)
        out.append((size, took))
        n -= took
        if took == there:
            queue.pop(0)
        else:
            queue[0][1] = there - took
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, trials: Iterable[tuple[int, int]] = TRIALS) -> list[Run]:
    """Bins for a histogram of lengths: runs (first bin, how many, [(length, copies in each)]).

    Each trial (part, groups) groups the lengths over `1 / part` of the capacity and fits the others
    afterwards; the plan with the fewest bins is taken.
    """
    plans = [_planned(histogram, capacity, groups, capacity // part) for part, groups in trials]
    return min(plans, key=lambda runs: sum(bins for _, bins, _ in runs))


def _planned(histogram: dict[int, int], capacity: int, groups: int, small: int) -> list[Run]:
    bins = _Bins(capacity)
    bins.open(histogram.get(capacity, 0), [(capacity, 1)])
    lengths = sorted(((size, n) for size, n in histogram.items() if n and size != capacity), reverse=True)
    queues = _grouped([x for x in lengths if x[0] > small], groups) if lengths and lengths[0][0] > small else []
    # Groups of the same rounded size are one size of the program.
    joint: dict[int, list[list[int]]] = {}
    for queue in queues:
        joint.setdefault(queue[0][0], []).extend(queue)
    sizes = list(joint)
    if sizes:
        demands = [sum(n for _, n in joint[s]) for s in sizes]
        for pattern, times in configurations(sizes, demands, capacity):
            n = int(times + 1e-7)
            if not n:
                continue
            slots = [_take(joint[s], n) for s, copies in zip(sizes, pattern, strict=True) for _ in range(copies)]
            while n:
                same = min(slot[0][1] for slot in slots)
                content: dict[int, int] = defaultdict(int)
                for i, slot in enumerate(slots):
                    size, there = slot[0]
                    if size:
                        content[size] += 1
                    slots[i] = slot[1:] if there == same else [(size, there - same), *slot[1:]]
                if content:
                    bins.open(same, sorted(content.items(), reverse=True))
                n -= same
    rest: dict[int, int] = defaultdict(int)
    for queue in joint.values():
        for size, n in queue:
            rest[size] += n
    for size, n in lengths:
        if size <= small:
            rest[size] += n
    for size in sorted(rest, reverse=True):
        bins.fit(size, rest[size])
    return bins.runs()


_RANK_BITS = 48


def _places(runs: list[Run], salt: int = _RANK_BITS) -> np.ndarray:
    """Rows (length and first rank in one number, bins in the run, first bin, offset of the first copy), sorted."""
    ranks: dict[int, int] = defaultdict(int)
    rows = []
    for first, n, content in sorted(runs, key=lambda run: run[0]):
        offset = 0
        for size, copies in content:
            rows.append(((size << salt) + ranks[size], n, first, offset))
            ranks[size] += n * copies
            offset += size * copies
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int = CAPACITY, trials: Iterable[tuple[int, int]] = TRIALS, bucket_rows: int = 250_000) -> DataFrame:
    """Give every stored piece its sequence_id and its offset there.

    The k-th piece of a length is found by counting within (length, bucket), where buckets come from a hash of the
    piece, so that a length that a third of all pieces have is spread. Reads `pieces` several times.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    places = _places(plan(histogram, capacity, trials))
    buckets = max(64, -(-sum(histogram.values()) // bucket_rows))
    order = ["doc_id", "piece", "ids_crc32"]
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    key = ["length", "_bucket"]
    ranked = dealt.withColumn("_within", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).join(before, key)
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_within")).drop("_before", "_within", "_bucket")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank"]

    def placed(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(places[:, 0], (length << _RANK_BITS) + rank, "right") - 1
            start, bins, first, offset = places[at].T if len(at) else np.zeros((4, 0), np.int64)
            nth = (length << _RANK_BITS) + rank - start
            kept = [i for i, name in enumerate(batch.schema.names) if name != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(first + nth % np.maximum(bins, 1)), pa.array(offset + nth // np.maximum(bins, 1) * length)],
                names=[*(batch.schema.names[i] for i in kept), "sequence_id", "offset"],
            )

    return ranked.mapInArrow(placed, ", ".join([*fields, "sequence_id long", "offset long"]))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY,
           end_id: int = END_ID, with_ids: bool = False, trials: Iterable[tuple[int, int]] = TRIALS) -> DataFrame:
    """Cut, store and pack documents; the pieces are encoded once and kept in the shared folder."""
    pieces = written(cut(docs, id_col, text_col, tokenizer, capacity, end_id, with_ids))
    return pack(pieces, capacity, trials).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces packed with their ids: sequence_id, ids, doc_ids in order."""
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
