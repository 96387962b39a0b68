"""Ranked lexical search by NRA: sequential reads of impact-sorted lists that keep a score interval for each document.

1. Index: documents are read once. Every task cuts what it reads into shards of at most about `shard_postings` postings and stores each as
   one row: its documents with their lengths, and for each term the documents that hold it. A shard is whole in
   itself, so nothing is shuffled, and a term that all documents hold is spread over all shards.
2. Weights: document frequencies are sums over the shards, taken for the terms of the queries only.
3. Search: in each shard the lists of the queries' terms are sorted by impact. A query reads its lists from the top, some
   entries of each in turn. The sum of what was read of a document is the lower end of its score; the upper end adds, for
   each list that has not shown it, what that list gives next at most. Reading goes on until no document outside
   the best `k` can reach them and every document that may belong to them, or tie with them, has a final score.
4. The shards' best, `k` rows a query from each at most, meet by query.

Queries are answered in blocks whose terms take at most `block_bytes`; a block's terms and weights go to
all tasks, and only these reach the driver.

Defined results: a null text has no terms and is not counted; a document without terms is not counted either; documents without an
identifier come last among equal scores; rows that repeat an identifier are documents of their own; items that agree in
identifier and text are one item, items of one identifier and different texts are answered apart; an item without terms, or
whose terms no document holds, has no rows; empty tables give no rows; texts of any length are read whole; columns
other than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.workspace import written
from .common import named, text_bytes, text_parts

K = 10
_LETTERS = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Lower-cases A-Z and turns every byte that no term holds into a space.
_TERM_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _LETTERS else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Letters, digits and everything beyond ASCII, A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split()


class _Shard:
    """Postings of the documents read since the last flush."""

    def __init__(self, only: frozenset[bytes] | None) -> None:
        self.only = only
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {term: i for i, term in enumerate(sorted(self.only))} if self.only is not None else {}
        self.ids, self.lengths, self.parts, self.postings, self.documents = [], [], [], 0, 0

    def add(self, ids, texts: list[bytes]) -> None:
        """Add documents; `ids` is an Arrow array."""
        import pyarrow as pa

        words = [terms_of(t) for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        held = np.flatnonzero(lengths)
        flat = [w for own in words for w in own]
        numbers = self.numbers
        if self.only is None:
            for w in flat:
                if w not in numbers:
                    numbers[w] = len(numbers)
        get = numbers.get
        codes = np.fromiter((get(w, -1) for w in flat), np.int64, len(flat))
        document = np.repeat(np.arange(len(held)), lengths[held])
        known = codes >= 0
        pair, tf = np.unique(codes[known] * max(1, len(held)) + document[known], return_counts=True)
        if len(held):
            self.parts.append((pair // len(held), pair % len(held) + self.documents, tf))
            self.ids.append(ids.take(pa.array(held)))
            self.lengths.append(lengths[held])
        self.postings += len(pair)
        self.documents += len(held)

    def row(self):
        """The shard as an Arrow batch of one row."""
        import pyarrow as pa

        term, document, tf = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        order = np.argsort(term, kind="stable")
        present, sizes = np.unique(term, return_counts=True)
        names = list(self.numbers)
        lengths = np.concatenate(self.lengths)
        ids = pa.concat_arrays(self.ids)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        texts = pa.array([names[i] for i in present.tolist()], pa.binary()).cast(pa.string())
        blob = lambda values, kind: pa.array([values.astype(kind).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([len(lengths)], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), one(ids), blob(lengths, "<i8"), one(texts), one(pa.array(sizes, pa.int64())), blob(document[order], "<i4"), blob(tf[order], "<i4")],
            names=["documents", "total", "ids", "lengths", "terms", "sizes", "document", "tf"],
        )


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: frozenset[str] | None = None, shard_postings: int = 400_000) -> DataFrame:
    """Shards of postings, one a row: for all terms, or only for some."""
    table = named(docs, doc_id=id_col, text=text_col).where(F.col("text").isNotNull())
    kind = table.schema["doc_id"].dataType.simpleString()
    wanted = None if only is None else frozenset(t.encode() for t in only)

    def shards(batches):
        shard = _Shard(wanted)
        for batch in (part for whole in batches for part in text_parts(whole, 1, 2 << 20)):
            shard.add(batch.column(0), text_bytes(batch.column(1)))
            if shard.postings >= shard_postings or shard.documents >= shard_postings:
                yield shard.row()
                shard.clear()
        if shard.documents:
            yield shard.row()

    return table.mapInArrow(shards, f"documents long, total long, ids array<{kind}>, lengths binary, terms array<string>, sizes array<long>, document binary, tf binary")


def best_of(lists: list[tuple[np.ndarray, np.ndarray]], documents: int, order: np.ndarray, k: int = K, first: int = 32) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best documents of impact-sorted lists (document, impact): their numbers, their scores, and how many entries were read.

    `order` decides between equal scores, smaller first.
    """
    lower = np.zeros(documents, np.int64)
    seen = np.zeros((len(lists), documents), bool)
    at = [0] * len(lists)
    met = np.zeros(0, np.int64)
    fresh = np.zeros(documents, bool)
    reads, step, open_ = 0, first, True
    while True:
        new = []
        for i, (document, impact) in enumerate(lists):
            if at[i] < len(document):
                part = slice(at[i], at[i] + step)
                rows = document[part]
                lower[rows] += impact[part]
                seen[i, rows] = True
                at[i] += len(rows)
                reads += len(rows)
                if open_:
                    new.append(rows)
        if open_ and new:
            rows = np.concatenate(new)
            fresh[rows] = True
            met = np.flatnonzero(fresh)
        bounds = np.array([int(impact[at[i]]) if at[i] < len(impact) else 0 for i, (_, impact) in enumerate(lists)], np.int64)
        total = int(bounds.sum())
        scores = lower[met]
        least = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0
        if total == 0:  # all that is left to read adds nothing
            break
        if total < least:
            open_ = False  # no document that has not been met can reach the best
            unread = np.flatnonzero(bounds)
            rest = (~seen[np.ix_(unread, met)]).T @ bounds[unread]
            may = scores + rest >= least
            met, rest = met[may], rest[may]
            if not rest.any():
                break
        step *= 2
    met = met[lower[met] > 0]
    top = met[np.lexsort((order[met], -lower[met]))][:k]
    return top, lower[top], reads


def _searched(shards: DataFrame, queries: dict[int, list[tuple[str, int]]], weights: dict[str, int], documents: int, total: int, k: int) -> DataFrame:
    """(_item, doc_id, score): every shard's best of each query, a list of (term, repeats)."""
    kind = shards.schema["ids"].dataType.elementType.simpleString()

    def found(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name: batch.column(batch.schema.get_field_index(name))[row]  # noqa: B023, E731
                lengths = np.frombuffer(cell("lengths").as_buffer(), "<i8")
                document, tf = (np.frombuffer(cell(c).as_buffer(), "<i4") for c in ("document", "tf"))
                ids = cell("ids").values
                ranks = np.empty(len(ids), np.int64)
                ranks[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                share = 8 * (25 + (75 * lengths * documents) // total)
                ends = np.cumsum(cell("sizes").values.to_numpy())
                sorted_lists = {}
                for i, term in enumerate(cell("terms").values.to_pylist()):
                    if weights.get(term, 0) > 0:
                        part = slice(ends[i - 1] if i else 0, ends[i])
                        count = tf[part].astype(np.int64)
                        impact = weights[term] * ((1_000_000_000 * count) // (1000 * count + share[document[part]]))
                        by_impact = np.argsort(-impact, kind="stable")
                        sorted_lists[term] = document[part][by_impact], impact[by_impact]
                items, tops, scores = [], [], []
                for item, own in queries.items():
                    lists = [(sorted_lists[t][0], n * sorted_lists[t][1]) for t, n in own if t in sorted_lists]
                    if lists:
                        top, score, _ = best_of(lists, len(lengths), ranks, k)
                        items.append(np.full(len(top), item))
                        tops.append(top)
                        scores.append(score)
                if items:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), ids.take(pa.array(np.concatenate(tops))), pa.array(np.concatenate(scores))], names=["_item", "doc_id", "score"])

    return shards.select("ids", "lengths", "terms", "sizes", "document", "tf").mapInArrow(found, f"_item long, doc_id {kind}, score long")


def query_terms(items: DataFrame) -> DataFrame:
    """(_item, term, repeats) of the texts of (_item, text)."""

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(item, term) for item, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True) for term in terms_of(text or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.binary()).cast(pa.string())], names=["_item", "term"])

    return items.select("_item", "text").mapInArrow(split, "_item long, term string").groupBy("_item", "term").agg(F.count(F.lit(1)).alias("repeats"))


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K,
           shard_postings: int = 400_000, block_bytes: int = 16 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above zero."""
    asked = named(items, item_id=item_id, text=item_text).where(F.col("text").isNotNull()).distinct()
    asked = written(asked.withColumn("_item", F.monotonically_increasing_id()))
    own = written(query_terms(asked))
    size = own.agg(F.coalesce(F.sum(F.octet_length("term") + 100), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    # The index holds the queries' terms only where these can go to every task.
    vocabulary = frozenset(r.term for r in own.select("term").distinct().collect()) if blocks == 1 else None
    shards = written(index(docs, id_col, text_col, vocabulary, shard_postings))
    whole = shards.agg(F.sum("documents").alias("documents"), F.sum("total").alias("total")).first()
    documents, total = whole.documents or 0, whole.total or 0
    lists = shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("list")).select("list.terms", "list.sizes")
    held = lists.groupBy(F.col("terms").alias("term")).agg(F.sum("sizes").alias("df"))
    placed = written(own.join(held, "term").withColumn("_block", F.pmod(F.xxhash64("_item"), F.lit(blocks))))
    found = None
    for block in range(blocks):
        queries: dict[int, list[tuple[str, int]]] = {}
        weights: dict[str, int] = {}
        for r in placed.where(F.col("_block") == block).orderBy("_item", "term").collect():  # block_bytes at most, give or take
            weights[r.term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1)))
            queries.setdefault(r._item, []).append((r.term, r.repeats))
        part = _searched(shards, queries, weights, documents, total, k)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("_item", "item_id"), "_item").select("item_id", "rank", "doc_id", "score")
