"""Token ids by a public tokenizer, with a cache of what each blank-free stretch of text gives."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Hashable
from functools import lru_cache

import numpy as np

#: Letters whose lower case is one letter of the same normal form, so that a word of them needs no normaliser.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"([{_LETTERS}]+)([!-/:-@\\[-`{{-~]*)")
#: What an entry of a cache takes beside its bytes.
ENTRY_BYTES = 200
#: Texts that tell whether a vocabulary allows the shortcuts.
PROBES = ("a", "The", "Straße", "ÉCOLE,", "word).", "don't", "one two", " two  Blanks\n\n\tand a line ", "Ends with blanks \n", "a1 b-2 <|x|> \u00a0\u200b x", "it's (A) \"b\"...", "日本語 テスト", "x" * 30)


def tokenizer_file(name: str) -> str:
    """A path as it is, or the place of a public tokenizer's file by its name."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + i)
    return table


class Cache(dict):
    """Byte strings by key in two generations of at most `limit` bytes: what the old one holds moves to the new one when it is asked for."""

    def __init__(self, make: Callable[[Hashable], bytes], limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.size = make, limit, 0
        self.old: dict[Hashable, bytes] = {}

    def __missing__(self, key) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        size = len(key) + len(found) + ENTRY_BYTES
        if size > ENTRY_BYTES + 512:  # long stretches seldom occur again
            return found
        if self.size + size > self.limit:
            self.old, self.size = dict(self), 0
            self.clear()
        self.size += size
        self[key] = found
        return found


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    If the vocabulary drops white space and never joins across it, a text's ids are those of its blank-free stretches in order,
    and if it lower-cases too, a stretch of plain letters and trailing marks goes straight to the merge model. Both are
    probed once; where they do not hold, texts are encoded whole. What the two caches hold is bounded in bytes.
    """

    def __init__(self, name: str, cache_bytes: int = 48 << 20) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file(name))
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.stretches, self.marks = Cache(self._stretch, cache_bytes), Cache(self._part, cache_bytes >> 4)
        self.plain = True
        self.plain = all(self._whole(t) == self._stretch(t.encode()) for t in PROBES if _PLAIN.fullmatch(t))
        self.stretches.clear()
        self.split = all(self._whole(t) == self._joined(t.encode()) for t in PROBES)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, word: str) -> bytes:
        shown = word.encode().decode("latin1").translate(self.letters)
        return b"".join([x.id.to_bytes(4, "little") for x in self.model.tokenize(shown)])

    def _stretch(self, stretch: bytes) -> bytes:
        text = stretch.decode("utf-8", "replace")
        plain = _PLAIN.fullmatch(text) if self.plain and len(stretch) <= 64 else None
        if plain is None:
            return self._whole(text)
        word, marks = plain.groups()
        low = word.lower()
        if marks or low != word:
            return self.stretches[low.encode()] + (self.marks[marks] if marks else b"")
        return self._part(word)

    def _joined(self, text: bytes) -> bytes:
        return b"".join(map(self.stretches.__getitem__, text.split()))

    def encode(self, text: bytes) -> bytes:
        return self._joined(text) if self.split else self._whole(text.decode("utf-8", "replace"))


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """One encoder for each worker process, kept across its tasks."""
    return Encoder(name)
