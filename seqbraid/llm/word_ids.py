"""Token ids of whole Arrow columns from a tokenizers file that folds case and drops white space.

No pre-token spans a blank or a newline, so a text is cut there and every distinct stretch
of a chunk of texts is encoded once; the ids of the chunk are then gathered in numpy. A
stretch that is a Latin-1 word with ASCII marks after it is put together from the ids of
the folded word and of the marks, as many stretches share those. Words and marks are sent
to the library many at a time, joined by blanks: each is one pre-token, whose last token
ends with the end-of-word suffix. All other stretches go to the library one by one.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from seqbraid.llm.common import kept

CHUNK_BYTES = 16 << 20
# Remembered words, marks and other stretches; all are forgotten when there are more.
MEMO_ENTRIES = 1_000_000
_JOINED = 256
# Letters with one case fold each, then marks that form one pre-token; no apostrophe, as
# the pre-tokeniser gives it a meaning of its own.
_WORD_AND_MARKS = (
    r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]*)"
    r"(?P<marks>[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)$"
)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of the index ranges start .. start + length - 1."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def _offsets(array: pa.Array) -> np.ndarray:
    """The offsets of a list array, from 0."""
    own = array.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return own - own[0]


class _Pool:
    """Ids of numbered entries; entry 0 has none."""

    def __init__(self):
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.used, self.size = 0, 1

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Append entries; returns the number of the first."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + len(ids)))
        if self.size + len(lengths) > len(self.starts):
            self.starts = np.resize(self.starts, 2 * (self.size + len(lengths)))
            self.lengths = np.resize(self.lengths, 2 * (self.size + len(lengths)))
        first, last = self.size, self.size + len(lengths)
        self.ids[self.used : self.used + len(ids)] = ids
        self.lengths[first:last] = lengths
        self.starts[first:last] = self.used + np.cumsum(lengths) - lengths
        self.used, self.size = self.used + len(ids), last
        return first


class WordIds:
    """The encoder; keeps what it has met, within MEMO_ENTRIES, between calls."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocab = self._tokenizer.get_vocab()
        with open(path, encoding="utf-8") as file:
            suffix = json.load(file)["model"]["end_of_word_suffix"]
        self._is_end = np.zeros(max(vocab.values()) + 1, bool)
        self._is_end[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self._memo_entries = memo_entries
        self._forget()

    def _forget(self) -> None:
        self._pool = _Pool()
        self._simple: dict[str, int] = {"": 0}
        self._other: dict[str, int] = {}

    def _numbers(self, memo: dict[str, int], parts: list[str], joined: bool) -> np.ndarray:
        """The pool's numbers of some distinct strings; the library encodes the new ones."""
        found = list(map(memo.get, parts))
        fresh = [i for i, known in enumerate(found) if known is None]
        if fresh:
            texts = [parts[i] for i in fresh]
            if joined:
                texts = [" ".join(texts[at : at + _JOINED]) for at in range(0, len(texts), _JOINED)]
            encoded = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.fromiter((i for own in encoded for i in own), np.uint32)
            if joined:
                lengths = np.diff(np.flatnonzero(self._is_end[ids]), prepend=-1)
                if len(lengths) != len(fresh) or lengths.sum() != len(ids):
                    raise ValueError("a word is not one pre-token of this tokenizer")
            else:
                lengths = np.array([len(own) for own in encoded], np.int64)
            number = self._pool.add(ids, lengths)
            for i in fresh:
                found[i] = memo[parts[i]] = number
                number += 1
        return np.array(found, np.int64)

    def _by_stretch(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Two pool numbers for every distinct stretch: its word and its marks."""
        split = pc.extract_regex(distinct, _WORD_AND_MARKS)
        plain = np.asarray(split.is_valid())
        numbers = []
        for column in ("word", "marks"):
            own = pc.utf8_lower(split.field(column).filter(split.is_valid())).dictionary_encode()
            known = self._numbers(self._simple, own.dictionary.to_pylist(), joined=True)
            of_all = np.zeros(len(distinct), np.int64)
            of_all[plain] = known[own.indices.to_numpy()] if len(own) else 0
            numbers.append(of_all)
        odd = np.flatnonzero(~plain)
        if len(odd):
            rest = distinct.take(pa.array(odd)).to_pylist()
            numbers[0][odd] = self._numbers(self._other, rest, joined=False)
        return numbers[0], numbers[1]

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self._simple) + len(self._other) > self._memo_entries:
            self._forget()
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        stretches = cut.flatten().dictionary_encode()
        word, marks = self._by_stretch(stretches.dictionary)
        pool = self._pool
        pair = np.stack((word, marks), axis=1).ravel()
        both = ragged(pool.starts[pair], pool.lengths[pair])
        lengths = pool.lengths[word] + pool.lengths[marks]
        starts = np.cumsum(lengths) - lengths
        at = stretches.indices.to_numpy()
        own = lengths[at]
        ids = pool.ids[both][ragged(starts[at], own)]
        ends = np.concatenate(([0], np.cumsum(own)))[_offsets(cut)]
        return ids, np.diff(ends)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column (null: empty), text after text, and the number of each."""
        texts = column.cast(pa.large_string()).fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        ids, counts, row = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while row < len(texts):
            before = sizes[row - 1] if row else 0
            last = max(row + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES, "right")))
            own, n = self._chunk(texts.slice(row, last - row))
            ids.append(own)
            counts.append(n)
            row = last
        return np.concatenate(ids), np.concatenate(counts)


def word_ids(path: str) -> WordIds:
    """The encoder of this worker process for a tokenizer file."""
    return kept(WordIds, path)
