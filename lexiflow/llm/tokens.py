"""Token ids of whole texts, word by word.

The word tokenizer drops white space, so a text's ids are its words' ids in order.  Each word is
encoded once per worker and then found by 128 bits of keyed hashes; texts become ids by one gather.
The tokenizer's file is read on the driver and shipped, so executors need no copy of it.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import SparkSession

from lexiflow.llm.common import chunks

#: Cached words per worker; beyond that the cache starts anew (speed only, never results).
CACHE_WORDS = 1_000_000

#: Marks that end a word as a run of their own; those of special tokens and the apostrophe are not among them.
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?%#&*$)]}")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


def _pieces(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans to encode, and each row's first span: words, with a tail of marks split off a letter or digit.

    The tokenizer ends a run of letters or digits there anyway, so ids stay the same while far
    fewer different spans need encoding.  Only ASCII letters, digits and the two-byte Latin
    letters U+00C0 to U+00FF (without the two signs among them) are followed by a split.
    """
    raw, starts, ends = words.raw, words.starts, words.ends
    body = ends.copy()
    moving = np.flatnonzero(_TAIL[raw[ends - 1]])
    while len(moving):
        body[moving] -= 1
        moving = moving[body[moving] > starts[moving]]
        moving = moving[_TAIL[raw[body[moving] - 1]]]
    at = np.flatnonzero((body < ends) & (body > starts))
    last = raw[body[at] - 1]
    before = raw[np.maximum(body[at] - 2, 0)]
    latin = (body[at] - starts[at] >= 2) & (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    at = at[_ALNUM[last] | latin]
    if not len(at):
        return starts, ends, words.first
    where = at + 1
    cut = body[at]
    all_starts = np.insert(starts, where, cut)
    all_ends = np.insert(ends, at, cut)
    return all_starts, all_ends, words.first + np.searchsorted(at, words.first)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class HashIndex:
    """Open addressing over pairs of uint64, with whole arrays per probe; a pair's value is its number."""

    def __init__(self, capacity: int):
        self.mask = (1 << max(4, (2 * capacity).bit_length())) - 1
        self.keys = np.zeros((2, self.mask + 1), np.uint64)
        self.values = np.full(self.mask + 1, -1, np.int32)
        self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of ``keys`` (2, n), -1 where absent."""
        out = np.full(keys.shape[1], -1, np.int64)
        left = np.arange(keys.shape[1])
        slots = (keys[0] & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            there = self.values[slots]
            hit = (there >= 0) & (self.keys[0, slots] == keys[0, left]) & (self.keys[1, slots] == keys[1, left])
            out[left[hit]] = there[hit]
            on = ~hit & (there >= 0)
            left, slots = left[on], (slots[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers new, distinct keys."""
        numbers = np.arange(self.used, self.used + keys.shape[1])
        self.used += len(numbers)
        left = np.arange(len(numbers))
        slots = (keys[0] & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.values[slots] < 0)
            self.values[slots[free]] = numbers[left[free]]  # of keys that want one slot the last gets it
            put = np.zeros(len(left), bool)
            put[free] = self.values[slots[free]] == numbers[left[free]]
            self.keys[:, slots[put]] = keys[:, left[put]]
            left, slots = left[~put], (slots[~put] + 1) & self.mask
        return numbers


def _distinct(keys: np.ndarray) -> np.ndarray:
    """A place of each different pair."""
    order = np.lexsort(keys)
    pairs = keys[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
    return order[new]


class WordTokenizer:
    """Encodes Arrow string columns.  ``definition`` is a tokenizer's JSON; its words must never span white space."""

    def __init__(self, definition: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.cache_words = cache_words
        self._reset()

    def _reset(self) -> None:
        self.index = HashIndex(self.cache_words)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.begin = np.zeros(self.cache_words + 1, np.int32)
        self.size = np.zeros(self.cache_words + 1, np.int32)
        self.used = 0

    def _add(self, keys: np.ndarray, words: list[str]) -> None:
        places = self.index.add(keys)
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            encoded = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.asarray(encoded.ids, np.uint32)
            owner = np.asarray([w if w is not None else -1 for w in encoded.word_ids], np.int64)
            if (owner < 0).any():  # a special token's text carries no word number
                one = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in part]
                ids = np.asarray([i for x in one for i in x], np.uint32)
                sizes = np.asarray([len(x) for x in one], np.int64)
            else:
                sizes = np.bincount(owner, minlength=len(part))
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(ids)] = ids
            own = places[at : at + len(part)]
            self.begin[own] = self.used + np.cumsum(sizes) - sizes
            self.size[own] = sizes
            self.used += len(ids)

    def _places(self, words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The cache place of every span."""
        if not len(starts):
            return np.zeros(0, np.int64)
        hashes = np.stack([words.hash_spans(starts, ends, lane) for lane in (0, 1)])
        found = self.index.find(hashes)
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found
        first = missing[_distinct(hashes[:, missing])]
        if self.index.used + len(first) > self.cache_words:
            missing, first = np.arange(len(found)), _distinct(hashes)
            self.cache_words = max(self.cache_words, len(first))
            self._reset()
        raw = words.raw.tobytes()
        spans = zip(starts[first].tolist(), ends[first].tolist(), strict=True)
        self._add(hashes[:, first], [raw[s:e].decode("utf-8", "replace") for s, e in spans])
        found[missing] = self.index.find(hashes[:, missing])
        return found

    def _chunks(self, column: pa.Array):
        """Spans are hashed in lower case, as the tokenizer reads them, save where special tokens may stand."""
        for row, words in chunks(column, lower=True):
            if b"<|" in words.raw.tobytes():
                words.data = words.raw
            yield row, words

    def counts(self, column: pa.Array) -> np.ndarray:
        """Ids per row."""
        out = [np.zeros(0, np.int64)]
        for _, words in self._chunks(column):
            starts, ends, first = _pieces(words)
            place = self._places(words, starts, ends)  # may start the cache anew: before its sizes are read
            size = np.concatenate([[0], np.cumsum(self.size[place], dtype=np.int64)])
            out.append(np.diff(size[first]))
        return np.concatenate(out)

    def encode(self, column: pa.Array):
        """Yields (first row, ids, offsets): the ids of row ``first + i`` are ids[offsets[i]:offsets[i + 1]]."""
        for row, words in self._chunks(column):
            if not len(words.starts):
                yield row, np.zeros(0, np.uint32), np.zeros(len(words.first), np.int64)
                continue
            spans, span_ends, first = _pieces(words)
            place = self._places(words, spans, span_ends)
            size, begin = self.size[place].astype(np.int64), self.begin[place].astype(np.int64)
            ends = np.cumsum(size)
            ids = self.pool[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]
            yield row, ids, np.concatenate([[0], ends])[first]


_encoders: dict[tuple[str, int], WordTokenizer] = {}

#: A shipped tokenizer: its digest and its JSON, some megabytes whatever the input.
Shipped = tuple[str, Broadcast]


def ship(spark: SparkSession, path: str | None = None) -> Shipped:
    """The tokenizer at ``path``, a file of the driver's, for all workers."""
    text = Path(path or default_tokenizer()).read_text(encoding="utf-8")
    return hashlib.sha256(text.encode()).hexdigest(), spark.sparkContext.broadcast(text)


def encoder(shipped: Shipped, cache_words: int = CACHE_WORDS) -> WordTokenizer:
    """One for each worker process and size of cache: later tasks and passes find the words of earlier ones."""
    key, text = shipped
    if (key, cache_words) not in _encoders:
        _encoders[key, cache_words] = WordTokenizer(text.value, cache_words)
    return _encoders[key, cache_words]
