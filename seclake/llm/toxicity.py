"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling.

Words (lower case, without marks at their ends) and their first four and five letters are hashed to rows of an embedding
table, and a word's vector is the sum of its rows; filters of one, two and three words slide over a whole text, the largest response of each filter is kept, and a logistic unit
weighs them. All of it is numpy. The classifier learns from all labelled texts. It starts from a bounded sample (at most `fit_rows`
different texts of each label and `fit_bytes` bytes of text, in one task) and goes on over every labelled text, whole, in shards of
about `shard_rows` side by side; a parameter takes the mean of its changes in the shards, each weighing as much as the shard had
to say about it. A fifth of the texts, by their hash, is held back from that to choose, for each language, the response at which a text counts as
toxic; scores are shifted so that this is 0.5. The language is guessed from the text itself by common function words, so that no
column but the text enters a score.

Rows that no labelled text uses are zero, so unseen words have no say beyond their beginnings. Texts are scored whole.

Defined results: null and empty texts score as texts without a word; where the labels hold only one class, all texts get the same
score, 0 or 1 (0 where there are no labels); a document with several labels is toxic if one says so; null labels are left out; repeated
rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import written
from .common import bounded_sample, id_text, named, skew_join, text_bytes, text_parts

#: Common function words, by which the calibration groups are told apart.
FUNCTION_WORDS = {
    "en": "the and of to in that is was for it with as his on be at by this had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur",
    "fr": "le la les et des en du une que est pour qui dans a par plus pas au sur ne se sont avec il ce ou mais comme on son cette ont aux ses leur été nous vous je même elle tout fait deux aussi bien sans peut",
    "es": "el la de que y los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
_MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "¡¿«»„“”‘’…–—"


@dataclass
class ToxicityModel:
    """Embeddings and filters; `thresholds` by LANGUAGES; `constant` where there was nothing to learn."""

    buckets: int = 1 << 15
    size: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    seed: int = 7
    constant: float | None = None
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def __post_init__(self) -> None:
        dice = np.random.default_rng(self.seed)
        self.embedding = dice.normal(0, 0.01, (self.buckets + 1, self.size)).astype(np.float32)
        self.embedding[self.buckets] = 0  # stands for the room after the last word
        self.kernels = [dice.normal(0, 0.5, (w, self.size, self.filters)).astype(np.float32) for w in self.widths]
        self.bias = [np.full(self.filters, 0.02, np.float32) for _ in self.widths]
        self.out = dice.normal(0, 0.5, len(self.widths) * self.filters).astype(np.float32)
        self.offset = 0.0
        #: Sums of squared steps, by which later steps are shortened; None before and after learning.
        self.sums: list[np.ndarray] | None = None

    def flat(self, sums: bool = False) -> np.ndarray:
        """All parameters, or the sums of their squared steps, as rows of eight, those of the embedding first."""
        parts = self.sums if sums else [self.embedding, *self.kernels, *self.bias, self.out, np.array([self.offset])]
        flat = np.concatenate([x.ravel().astype(np.float64) for x in parts])
        return np.concatenate([flat, np.zeros(-len(flat) % 8)]).reshape(-1, 8)

    def add(self, changes: np.ndarray) -> None:
        """Change all parameters by rows such as `flat` gives."""
        left = changes.ravel()
        for x in (self.embedding, *self.kernels, *self.bias, self.out):
            x += left[: x.size].reshape(x.shape).astype(np.float32)
            left = left[x.size :]
        self.offset += float(left[0])

    def vectors(self, features: np.ndarray) -> np.ndarray:
        return self.embedding[features].sum(axis=1)

    def padded(self, words: np.ndarray) -> np.ndarray:
        return np.concatenate([words, np.zeros(max(self.widths), words.dtype)])

    def response(self, words: np.ndarray, features: np.ndarray, table: np.ndarray, part: int = 20_000) -> float:
        """The logit of a text of word numbers with these features; `table` is that of `responses`."""
        words = self.padded(words)
        n, wide = len(words) - max(self.widths) + 1, max(self.widths) - 1
        best = np.full(len(self.out), -np.inf, np.float32)
        for start in range(0, n, part):
            own = features[words[start : start + part + wide]]
            rows = table[own[:, 0]]
            for i in range(1, own.shape[1]):
                rows += table[own[:, i]]
            at = col = 0
            m = min(part, n - start)
            for i, w in enumerate(self.widths):
                total = rows[:m, col : col + self.filters]
                for j in range(1, w):
                    total = total + rows[j : j + m, col + j * self.filters : col + (j + 1) * self.filters]
                best[at : at + self.filters] = np.maximum(best[at : at + self.filters], total.max(axis=0) + self.bias[i])
                at, col = at + self.filters, col + w * self.filters
        return float(np.maximum(best, 0) @ self.out + self.offset)

    def responses(self) -> np.ndarray:
        """What each row of the embedding gives to each filter at each of its places."""
        return np.concatenate([self.embedding @ k[j] for k in self.kernels for j in range(len(k))], axis=1)

    def train(self, texts: list[np.ndarray], labels: np.ndarray, features: np.ndarray, epochs: int = 15, least: int = 250, batch: int = 32, rate: float = 0.1, decay: float = 1e-4,
              counts: dict[int, int] | None = None) -> None:
        """Adagrad on the logistic loss, for at least `least` steps; both classes weigh the same, by `counts` if given. Word 0 is the room after the last word.

        A model that has learned before goes on from there. Every text is used `epochs` times at least.
        """
        dice, fresh = np.random.default_rng(self.seed + 1), self.sums is None
        if fresh:
            self.sums = [np.full_like(x, 1e-2) for x in (self.embedding, *self.kernels, *self.bias, self.out)] + [np.full(1, 1e-2)]
            self.sums[0][:] = 1e-3
        sums = self.sums
        counts = counts or {1: int(labels.sum()), 0: int((1 - labels).sum())}
        weight = np.where(labels == 1, 0.5 / max(1, counts[1]), 0.5 / max(1, counts[0])) * sum(counts.values())
        texts = [self.padded(t) for t in texts]
        wide, order = max(self.widths) - 1, np.zeros(0, np.int64)
        for _ in range(max(least, epochs * -(-len(texts) // batch))):
            if not len(order):
                order = dice.permutation(len(texts))
            chosen, order = order[:batch], order[batch:]
            words = np.concatenate([texts[i] for i in chosen])
            sizes = np.array([len(texts[i]) for i in chosen])
            starts = np.cumsum(sizes) - sizes
            used, where = np.unique(words, return_inverse=True)
            vectors = self.vectors(features[used])
            pooled, places = [], []
            for kernel, bias in zip(self.kernels, self.bias, strict=True):
                total = (vectors @ kernel[0])[where]
                for j in range(1, len(kernel)):
                    total[: len(total) - j] += (vectors @ kernel[j])[where[j:]]
                top = np.stack([s + total[s : s + n - wide].argmax(axis=0) for s, n in zip(starts, sizes, strict=True)])
                places.append(top)
                pooled.append(np.take_along_axis(total, top, 0) + bias)
            hidden = np.concatenate(pooled, axis=1)
            alive = np.maximum(hidden, 0)
            p = 1 / (1 + np.exp(-np.clip(alive @ self.out + self.offset, -30, 30)))
            error = ((p - labels[chosen]) * weight[chosen] / min(batch, len(texts))).astype(np.float32)
            back = error[:, None] * self.out * (hidden > 0)
            changes, bias_changes, moved = [], [], np.zeros_like(vectors)
            touched = []
            for i, (kernel, top) in enumerate(zip(self.kernels, places, strict=True)):
                part = back[:, i * self.filters : (i + 1) * self.filters]
                change = np.empty_like(kernel)
                for j in range(len(kernel)):
                    row = where[top + j]
                    change[j] = np.einsum("bf,bfd->df", part, vectors[row])
                    np.add.at(moved, row.ravel(), (part[:, :, None] * kernel[j].T[None]).reshape(-1, self.size))
                    touched.append(row.ravel())
                changes.append(change)
                bias_changes.append(part.sum(axis=0))
            rows = np.unique(np.concatenate(touched))
            own, at = np.unique(features[used[rows]], return_inverse=True)
            step = np.zeros((len(own), self.size), np.float32)
            np.add.at(step, at.ravel(), np.repeat(moved[rows], features.shape[1], axis=0))
            step += decay * self.embedding[own]
            step[own == self.buckets] = 0
            sums[0][own] += step**2
            self.embedding[own] -= rate * step / np.sqrt(sums[0][own])
            for i, (change, bias_change) in enumerate(zip(changes, bias_changes, strict=True)):
                sums[1 + i] += change**2
                self.kernels[i] -= rate * change / np.sqrt(sums[1 + i])
                k = 1 + len(self.kernels) + i
                sums[k] += bias_change**2
                self.bias[i] -= 0.1 * rate * bias_change / np.sqrt(sums[k])
            out_step = alive.T @ error + decay * self.out
            sums[-2] += out_step**2
            self.out -= rate * out_step / np.sqrt(sums[-2])
            offset_step = float(error.sum())
            sums[-1] += offset_step**2
            self.offset -= rate * offset_step / float(sums[-1][0]) ** 0.5
        if not fresh:
            return
        seen = np.zeros(self.buckets + 1, bool)
        seen[np.unique(features[np.unique(np.concatenate(texts))])] = True
        self.embedding[~seen] = 0
        self.embedding[self.buckets] = 0


class _Words(dict):
    """Numbers of blank-free stretches from 1; the features of their words and their votes for languages."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets
        self.common = {l: frozenset(w.split()) for l, w in FUNCTION_WORDS.items()}
        self.features, self.votes = np.full((1, 3), buckets, np.int32), np.zeros((1, len(self.common)), np.int8)
        self.new: list[tuple[list[int], list[bool]]] = []

    def __missing__(self, stretch: bytes) -> int:
        word = stretch.decode("utf-8", "replace").lower().strip(_MARKS)
        rows = [xxhash.xxh3_64_intdigest(x) % self.buckets for x in (word, "4" + word[:4], "5" + word[:5])]
        self.new.append((rows, [word in c for c in self.common.values()]))
        number = self[stretch] = len(self) + 1
        return number

    def of(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
        """For each text the numbers of its words and the index of its language."""
        numbers = []
        for text in texts:
            words = text.split()
            numbers.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
            if len(self.new) > 20_000:
                self.grow()
        self.grow()
        counts = [self.votes[n].sum(axis=0, dtype=np.int64) for n in numbers]
        return numbers, [int(c.argmax()) if c.any() else len(self.common) for c in counts]

    def grow(self) -> None:
        if self.new:
            rows, votes = zip(*self.new, strict=True)
            self.features = np.concatenate([self.features, np.array(rows, np.int32)])
            self.votes = np.concatenate([self.votes, np.array(votes, np.int8)])
            self.new = []


def _threshold(responses: np.ndarray, labels: np.ndarray, weight: float) -> float:
    """The response that parts the classes with the fewest weighted errors, half-way between its neighbours."""
    order = np.argsort(responses, kind="stable")
    responses, labels = responses[order], labels[order]
    missed = np.concatenate([[0], np.cumsum(labels == 1)])
    false = np.concatenate([[0], np.cumsum(labels == 0)])
    errors = missed + weight * (false[-1] - false)
    best = np.flatnonzero(errors == errors.min())
    cut = int(best[len(best) // 2])
    low = responses[cut - 1] if cut else responses[0] - 1
    high = responses[cut] if cut < len(responses) else responses[-1] + 1
    return float((low + high) / 2)


def _threshold_of_counts(responses: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """As `_threshold`, of ascending different responses with their numbers of clean and toxic texts."""
    errors = np.concatenate([[0], np.cumsum(toxic)]) + clean.sum() - np.concatenate([[0], np.cumsum(clean)])
    best = np.flatnonzero(errors == errors.min())
    cut = int(best[len(best) // 2])
    low = responses[cut - 1] if cut else responses[0] - 1
    high = responses[cut] if cut < len(responses) else responses[-1] + 1
    return float((low + high) / 2)


def labelled(docs: DataFrame, marks: DataFrame, most_marks: int = 500_000) -> DataFrame:
    """(toxic, text, at, deal) of every document with a mark: hashes of its text, and of its text and identifier. At most `most_marks` marks are sent to the texts, more are met by a shuffle."""
    texts = docs.where(F.col("doc_id").isNotNull())
    if marks.limit(most_marks + 1).count() <= most_marks:
        rows = texts.join(F.broadcast(marks), "doc_id")
    else:
        rows = skew_join(texts, written(marks).hint("shuffle_hash"), ["doc_id"], "inner")
    text = F.coalesce("text", F.lit(""))
    return rows.select("toxic", text.alias("text"), F.xxhash64(text).alias("at"), F.xxhash64("doc_id", text).alias("deal"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 2000,
        fit_bytes: int = 16_000_000, calibration_rows: int = 15, shard_rows: int = 10_000, **options) -> ToxicityModel:
    """Fit on the given labels, all of them. A language with fewer than `calibration_rows` held-back texts of a class takes the common threshold."""
    marks = named(labels, doc_id=id_col, toxic=label_col).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = written(labelled(named(docs, doc_id=id_col, text=text_col), marks))
    held = F.pmod("at", F.lit(5)) == 0
    n = {(r.toxic, r.held): r["count"] for r in rows.groupBy("toxic", held.alias("held")).count().collect()}
    present = {label for label, _ in n}
    if len(present) < 2:
        return ToxicityModel(constant=float(max(present, default=0)), **options)
    # Each part needs both classes; where one lacks them, there are too few texts to hold any back.
    both = lambda part: {(0, part), (1, part)} <= set(n)
    taught, asked = rows.where(~held) if both(False) else rows, rows.where(held) if both(True) else rows
    counts = {label: sum(x for (own, part), x in n.items() if own == label and not (part and both(False))) for label in (0, 1)}
    model = _refined(taught, _started(taught, counts, fit_rows, fit_bytes, calibration_rows, options), counts, -(-sum(counts.values()) // shard_rows))
    model.thresholds = _thresholds(asked, model, calibration_rows)
    return model


def _started(rows: DataFrame, counts: dict[int, int], fit_rows: int, fit_bytes: int, calibration_rows: int, options: dict) -> ToxicityModel:
    """A first model of a bounded sample, trained in one task; the driver only sees the model."""
    sample = bounded_sample(rows, "toxic", fit_rows, fit_bytes)

    def train(batches):
        import pyarrow as pa

        given = [(text or b"", label) for batch in batches for text, label in zip(text_bytes(batch.column(1)), batch.column(0).to_pylist(), strict=True)]
        given.sort(key=lambda x: xxhash.xxh3_64_intdigest(x[0]))  # the same order whatever the tasks before
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(fitted(given, counts, calibration_rows, **options)))], pa.binary())], names=["model"])

    model = ToxicityModel(**options)
    learned = sample.select("toxic", "text").coalesce(1).mapInArrow(train, "model binary").first()
    known = pickle.loads(learned.model) if learned else {"constant": 0.0}
    if known["constant"] is None:  # else the sample has one class only, as the other's texts are too long for it
        vars(model).update(known)
    return model


def _refined(rows: DataFrame, model: ToxicityModel, counts: dict[int, int], shards: int) -> ToxicityModel:
    """The model after one more look at every row. Each shard goes on from the model by itself; sums over shards come back, for each row of `flat`."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    n = model.flat().size // 8

    def changes(batches):
        import pyarrow as pa

        own, before = pickle.loads(pickle.dumps(shared.value)), shared.value
        words = _Words(own.buckets)
        for batch in batches:
            for part in text_parts(batch, 1, 4 << 20):
                texts, _ = words.of(text_bytes(part.column(1)))
                own.train(texts, part.column(0).to_numpy(), words.features, epochs=1, least=0, counts=counts)
                if len(words) > 200_000:
                    words = _Words(own.buckets)
        if own.sums is None:  # no text came
            return
        said = own.flat(sums=True) - (before.flat(sums=True) if before.sums else 0)
        moved = (own.flat() - before.flat()) * said
        used = np.flatnonzero(said.any(axis=1))
        columns = [pa.array(x[used, i]) for x in (said, moved) for i in range(8)]
        yield pa.RecordBatch.from_arrays([pa.array(used), *columns], names=["row", *names])

    names = [f"{kind}{i}" for kind in ("said", "moved") for i in range(8)]
    # Not by the text alone, of which there may be many copies; in an order that does not depend on how the table is stored.
    dealt = rows.repartition(shards, "deal").sortWithinPartitions("deal", "at").select("toxic", "text")
    told = dealt.mapInArrow(changes, "row long, " + ", ".join(f"{c} double" for c in names))
    total = np.zeros((n, 16))
    for r in told.groupBy("row").agg(*[F.sum(c).alias(c) for c in names]).collect():
        total[r.row] = r[1:]
    shared.unpersist()
    model.add(np.divide(total[:, 8:], total[:, :8], out=np.zeros((n, 8)), where=total[:, :8] > 0))
    model.sums = None
    return model


def _thresholds(rows: DataFrame, model: ToxicityModel, calibration_rows: int, steps: int = 256, most: int = 32) -> np.ndarray:
    """By LANGUAGES, the response that parts the classes best among all rows. Responses are counted in steps of 1 / `steps` up to `most`."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def responses(batches):
        import pyarrow as pa

        own, words = shared.value, _Words(shared.value.buckets)
        table = own.responses()
        for batch in batches:
            for part in text_parts(batch, 1, 2 << 20):
                texts, languages = words.of(text_bytes(part.column(1)))
                found = np.array([own.response(t, words.features, table) for t in texts])
                at = np.rint(np.clip(found, -most, most) * steps).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(languages, pa.int32()), pa.array(at)], names=["toxic", "language", "at"])
                if len(words) > 200_000:
                    words = _Words(own.buckets)

    found = rows.select("toxic", "text").mapInArrow(responses, "toxic int, language int, at long").groupBy("toxic", "language", "at").count().collect()
    shared.unpersist()
    grid = np.zeros((len(LANGUAGES), 2 * most * steps + 1, 2), np.int64)
    for r in found:
        grid[r.language, r.at + most * steps, r.toxic] = r["count"]

    def parted(counts: np.ndarray) -> float:
        met = np.flatnonzero(counts.any(axis=1))
        return _threshold_of_counts(met / steps - most, counts[met, 0], counts[met, 1])

    common = parted(grid.sum(axis=0))
    return np.array([parted(own) if own.sum(axis=0).min() >= calibration_rows else common for own in grid])


def fitted(rows: list[tuple[bytes, int]], counts: dict[int, int], calibration_rows: int = 15, **options) -> ToxicityModel:
    model = ToxicityModel(**options)
    given = np.array([label for _, label in rows], np.int64)
    if len(set(given.tolist())) < 2:
        model.constant = float(given[0]) if len(given) else 0.0
        return model
    words = _Words(model.buckets)
    texts, languages = words.of([text for text, _ in rows])
    order = np.random.default_rng(model.seed).permutation(len(rows))
    # Each class is split by itself, so that both halves have it.
    held = np.zeros(len(rows), bool)
    for label in (0, 1):
        own = order[given[order] == label]
        held[own[: len(own) // 5]] = True
    model.train([texts[i] for i in np.flatnonzero(~held)], given[~held], words.features)
    table, asked = model.responses(), np.flatnonzero(held) if held.any() and len(set(given[held].tolist())) == 2 else np.arange(len(rows))
    responses = np.array([model.response(texts[i], words.features, table) for i in asked])
    own, language = given[asked], np.array(languages)[asked]
    weight = (counts[0] / max(1, (own == 0).sum())) / (counts[1] / max(1, (own == 1).sum()))
    common = _threshold(responses, own, weight)
    for i in range(len(LANGUAGES)):
        here = language == i
        enough = min((own[here] == 0).sum(), (own[here] == 1).sum()) >= calibration_rows
        model.thresholds[i] = _threshold(responses[here], own[here], weight) if enough else common
    return model


class _Scorer:
    """Scores of texts; what is known of the words seen so far is kept up to a limit."""

    def __init__(self, model: ToxicityModel, limit: int = 400_000) -> None:
        self.model, self.limit = model, limit
        self.words, self.table = _Words(model.buckets), model.responses()

    def __call__(self, text: bytes) -> float:
        if self.model.constant is not None:
            return self.model.constant
        return float(self.many([text])[0])

    def many(self, texts: list[bytes]) -> np.ndarray:
        """Scores of a batch."""
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        if len(self.words) > self.limit:
            self.words = _Words(self.model.buckets)
        coded, languages = self.words.of(texts)
        x = np.array([self.model.response(rows, self.words.features, self.table) - self.model.thresholds[language] for rows, language in zip(coded, languages, strict=True)])
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _in_parts(texts: list[bytes], size: int = 2_000_000):
    """Lists of consecutive texts of about so many bytes."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def _scores(scorer: _Scorer, texts: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(scorer.many(part) for part in _in_parts(texts))])


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, score, predicted."""
    table = id_text(docs, id_col, text_col)
    kind = table.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        import pyarrow as pa

        scorer = _Scorer(shared.value)
        for batch in batches:
            found = _scores(scorer, text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return table.mapInArrow(scored, f"doc_id {kind}, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns; nothing is shuffled."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches):
        import pyarrow as pa

        scorer = _Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(_scores(scorer, [t or b"" for t in text_bytes(batch.column(at))]) < 0.5))

    return docs.mapInArrow(clean, docs.schema)
