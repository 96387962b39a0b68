"""Language identification by known words first, then by shorter and shorter character n-grams.

Training counts words per language. A word that was seen often enough scores by its smoothed log frequency in each
language. Any other word is scored by its character n-grams of the longest length of which one is known, from
`longest` down to single letters; each n-gram by its smoothed log frequency, averaged over the word. The language
with the largest sum over all words of a text wins.

The model is fitted on at most `fit_rows` different texts a language, of at most `fit_bytes` bytes together, taken in the order
of a hash of the text; prediction reads every text whole.
The words of a task are scored once and kept while the task runs.

Defined results: a text that is null or holds no letter is `und` with score 0; without any training row all
texts are `und`; ties go to the language that comes first by name; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, id_text, named, text_bytes

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between marks of its ends."""
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class LanguageModel:
    """Log frequencies of words and n-grams, one column a language."""

    def __init__(self, counts: dict[str, Counter], longest: int = 5, min_count: int = 3, smooth: float = 0.5) -> None:
        self.languages = sorted(counts)
        self.longest = longest
        known = [Counter({w: n for w, n in counts[l].items() if n >= min_count}) for l in self.languages]
        self.words = self._logs(known, smooth)
        # n-grams of distinct words, so that frequent words do not drown the shapes of rare ones
        self.tables = {}
        for n in range(1, longest + 1):
            seen = []
            for l in self.languages:
                c: Counter = Counter()
                for w in counts[l]:
                    c.update(grams(w, n))
                seen.append(c if n == 1 else Counter({g: k for g, k in c.items() if k >= min_count}))
            self.tables[n] = self._logs(seen, smooth)
        self.other = (0.0,) * len(self.languages)

    @staticmethod
    def _logs(counts: list[Counter], smooth: float) -> dict[str, tuple[float, ...]]:
        entries = sorted(set().union(*counts)) if counts else []
        if not entries:
            return {}
        table = np.array([[c[e] for c in counts] for e in entries], np.float64) + smooth
        return dict(zip(entries, map(tuple, np.log(table / table.sum(axis=0)).tolist()), strict=True))

    def word(self, word: str) -> tuple[float, ...]:
        found = self.words.get(word)
        if found is not None:
            return found
        for n in range(min(self.longest, len(word) + 2), 0, -1):
            table = self.tables[n]
            known = [table[g] for g in grams(word, n) if g in table]
            if known:
                return tuple([sum(column) / len(known) for column in zip(*known, strict=True)])
        return self.other


class _Scores(dict):
    """Rows of scores for blank-free stretches of text: the sum over the stretch's words, their number, whether it has letters."""

    def __init__(self, model: LanguageModel) -> None:
        super().__init__()
        self.model, self.new, self.by_word = model, [], {}
        self.matrix, self.used = np.zeros((1024, len(model.languages) + 2), np.float32), 0

    def __missing__(self, stretch: bytes) -> int:
        text = stretch.decode("utf-8", "replace")
        found = words(text)
        scores = [self.score(w) for w in found]
        total = scores[0] if len(scores) == 1 else [sum(column) for column in zip(*scores, strict=True)] or self.model.other
        letters = any(w.isalpha() for w in found) or any(map(str.isalpha, text))
        self.new.append((*total, len(found), letters))
        number = self[stretch] = len(self)
        return number

    def score(self, word: str) -> tuple[float, ...]:
        found = self.by_word.get(word)
        if found is None:
            found = self.by_word[word] = self.model.word(word)
        return found

    def total(self, stretches: list[bytes]) -> np.ndarray:
        numbers = np.fromiter(map(self.__getitem__, stretches), np.int64, len(stretches))
        if self.new:
            end = self.used + len(self.new)
            if end > len(self.matrix):
                grown = np.zeros((2 * end, self.matrix.shape[1]), np.float32)
                grown[: self.used] = self.matrix[: self.used]
                self.matrix = grown
            self.matrix[self.used : end] = self.new
            self.used, self.new = end, []
        return self.matrix[numbers].sum(axis=0, dtype=np.float64)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", fit_rows: int = 2000, fit_bytes: int = 16_000_000, **options) -> LanguageModel:
    """Fit on a bounded sample of the given rows; languages are the distinct non-null values of `lang_col` there."""
    rows = named(docs, lang=lang_col, text=text_col).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = bounded_sample(rows, "lang", fit_rows, fit_bytes)
    counts: dict[str, Counter] = {r.lang: Counter() for r in rows.select("lang").distinct().collect()}
    for r in sample.toLocalIterator():
        counts[r.lang].update(words(r.text))
    return LanguageModel(counts, **options)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, lang_pred, score (the winner's share of the likelihood, tempered by length)."""
    table = id_text(docs, id_col, text_col)
    kind = table.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit_bytes

    def predicted(batches):
        import pyarrow as pa

        model = shared.value
        scores = _Scores(model)
        for batch in batches:
            names, shares = [], []
            for text in text_bytes(batch.column(1)):
                if len(scores) > 400_000:
                    scores = _Scores(model)
                total = scores.total(text.split())
                if not total[-1] or not model.languages:
                    names.append(UNKNOWN)
                    shares.append(0.0)
                    continue
                likely = total[:-2] / max(1.0, total[-2]) * min(total[-2], 20.0)
                odds = np.exp(likely - likely.max())
                names.append(model.languages[int(odds.argmax())])
                shares.append(float(odds.max() / odds.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return table.mapInArrow(predicted, f"doc_id {kind}, lang_pred string, score double")
