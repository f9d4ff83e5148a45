"""Token ids of whole texts by a public word-level BPE file, with the ids of words kept in memory.

The file's pre-tokenizer cuts at white space and drops it, so a text's ids are those of its words
in order, and a word's ids depend on the word alone. It also cuts between letters and other
characters, so a word of letters followed by full stops or commas is two parts. Words are counted
off in Arrow; only parts not met before go through the tokenizer, plain ones many at a time and
past its normalizer, which would leave them as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, models, pre_tokenizers

_KEPT = 300_000            # words kept between batches; beyond it the memory starts anew
_TOGETHER = 500            # plain parts that go through the model as one text
_WORD_END = "</w>"
_shared: dict[str, WordTokenizer] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """For byte-level BPE files with word ends, lower case, and white space dropped."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        assert isinstance(self.tokenizer.model, models.BPE)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(_WORD_END)]] = True
        self.letters = _byte_letters()
        self.forget()

    @classmethod
    def shared(cls, path: str) -> WordTokenizer:
        """One per worker process."""
        if path not in _shared:
            _shared[path] = cls(path)
        return _shared[path]

    def forget(self):
        """Drop the words that are kept."""
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {"": 0}
        self.word_parts = np.zeros((1 << 14, 2), np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begins, self.counts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _store(self, parts: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.parts)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(parts) > len(self.begins):
            self.begins = np.concatenate([self.begins, np.zeros_like(self.begins)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.counts[n:n + len(parts)] = counts
        self.begins[n:n + len(parts)] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.parts.update(zip(parts, range(n, n + len(parts))))

    def _learn_parts(self, plain: list[str], other: list[str]) -> None:
        for at in range(0, len(plain), 20_000):
            some = plain[at:at + 20_000]
            texts = [" ".join(some[k:k + _TOGETHER]) for k in range(0, len(some), _TOGETHER)]
            # A space stays a space, so that the words stay apart.
            table = {**self.letters, 32: " "}
            spelled = [t if t.isascii() else t.encode().decode("latin-1").translate(table)
                       for t in texts]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in
                                  self.model.encode_batch_fast(spelled, add_special_tokens=False)])
            last = np.flatnonzero(self.ends_word[ids])
            self._store(some, ids, np.diff(last, prepend=-1))
        if other:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(
                other, add_special_tokens=False)]
            self._store(other, np.fromiter((i for own in found for i in own), np.uint32),
                        np.fromiter(map(len, found), np.int64, len(found)))

    def _learn(self, words: list[str]) -> None:
        """Cut new words into a plain part of letters and the stops behind it, or leave them whole."""
        bases, tails, plain, other = [], [], {}, {}
        for w in words:
            base = w.rstrip(".,")
            low = base.lower()
            if low.isalpha() and base.isalpha() and "Σ" not in base and (
                    low.isascii() or unicodedata.is_normalized("NFC", base)
                    and unicodedata.is_normalized("NFC", low)):
                tail = w[len(base):]
                if low not in self.parts:
                    plain[low] = None
                if tail not in self.parts:
                    other[tail] = None
            else:
                low, tail = w, ""
                # A whole word may look like a plain part only if it is one.
                if w not in self.parts:
                    other[w] = None
            bases.append(low)
            tails.append(tail)
        self._learn_parts(list(plain), list(other))
        n = len(self.words)
        while n + len(words) > len(self.word_parts):
            self.word_parts = np.concatenate([self.word_parts, np.zeros_like(self.word_parts)])
        at = self.parts.__getitem__
        self.word_parts[n:n + len(words), 0] = np.fromiter(map(at, bases), np.int32, len(words))
        self.word_parts[n:n + len(words), 1] = np.fromiter(map(at, tails), np.int32, len(words))
        self.words.update(zip(words, range(n, n + len(words))))

    def encode(self, texts: pa.Array, limit: int = 3 << 20
               ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First row, ids of the rows in a run, and where each row's ids begin and end."""
        texts = pc.fill_null(texts, "")
        at, sizes = 0, pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(sizes)
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(total, total[at] - sizes[at] + limit, "right")))
            yield at, *self._run(texts.slice(at, to - at))
            at = to

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten()
        row_words = np.concatenate([[0], np.cumsum(
            pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if not names:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if len(self.words) + len(names) > _KEPT:
            self.forget()
        new = [w for w in names if w not in self.words]
        if new:
            self._learn(new)
        place = np.fromiter(map(self.words.__getitem__, names), np.int64, len(names))
        of = self.word_parts[place[coded.indices.to_numpy()]].ravel()
        counts = self.counts[of]
        ends = np.cumsum(counts)
        source = np.arange(ends[-1]) + np.repeat(self.begins[of] - (ends - counts), counts)
        return self.flat[source], np.concatenate([[0], ends])[2 * row_words]
