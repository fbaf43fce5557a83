"""Tokenising of whole Arrow batches with numpy, shared by the operators.

A batch of texts is one byte buffer. Words are found by comparing neighbouring
bytes' classes, and hashed by one running sum over the buffer, so no step loops
over words in Python. Long batches are cut between texts into chunks; a text
longer than a chunk is a chunk by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK, MOST_TEXTS = 1_000_000, 20_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~SPACES
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased UTF-8 text.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def _power(up: bool, n: int) -> np.ndarray:
    if len(_powers[up]) < n:
        x = np.full(max(n, CHUNK + 1), _BASE if up else _INVERSE, np.uint64)
        x[0] = 1
        _powers[up] = np.multiply.accumulate(x)
    return _powers[up][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of several texts: byte spans in ``data``, and per text the range of its words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words
    at: int  # index of the first text in the batch

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word that depends on its bytes only."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _power(True, n), out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * _power(False, n)[self.starts])

    def joined(self) -> tuple[str, np.ndarray]:
        """All words with one space before, between and after them, a character a byte, and where each begins."""
        lengths = self.ends - self.starts
        at = np.cumsum(lengths + 1) - lengths
        out = np.full(int(lengths.sum()) + len(lengths) + 1, 32, np.uint8)
        if len(lengths):
            shift = np.repeat(at - self.starts, lengths)
            source = np.arange(len(shift)) + np.repeat(self.starts - (np.cumsum(lengths) - lengths), lengths)
            out[source + shift] = self.data[source]
        return out.tobytes().decode("latin-1"), at

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, offsets, bytes) of runs of texts of about ``limit`` bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(buffers[2]) else np.empty(0, np.uint8)
    if texts.null_count:  # a null may stand over bytes
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
        yield from chunks(texts, limit)
        return
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n, i + MOST_TEXTS)
        yield i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


def split(texts: pa.Array, of_word: np.ndarray = NOT_SPACE, table: np.ndarray = LOWER, accents: bool = False) -> Iterator[Words]:
    """Words of each chunk, bytes mapped by ``table`` (A-Z lower-cased); ``of_word`` tells the mapped bytes of words from others. ``accents`` lower-cases the Latin-1 letters, too."""
    for at, offsets, raw in chunks(texts):
        data = table[raw]
        if accents and len(data):
            second = np.flatnonzero(raw[:-1] == 0xC3) + 1
            second = second[(raw[second] <= 0x9E) & (raw[second] != 0x97)]
            data[second] += 32
        inside = of_word[data]
        edges = np.zeros(len(data) + 1, bool)
        edges[offsets] = True  # a word ends with its text
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
            before &= ~edges[:-1]
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        if len(data):
            after[:-1] = inside[1:]
            after &= ~edges[1:]
        ends = np.flatnonzero(inside & ~after) + 1
        yield Words(data, starts, ends, np.searchsorted(starts, offsets), at)


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``n`` words; of shorter texts the whole sequence."""
    h, counts, first = words.hashes(), words.counts, words.first[:-1]
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    factors = np.array([pow(0xD6E8FEB86659FD93, j + 1, 2**64) for j in range(n)], np.uint64)
    runs = max(0, len(h) - n + 1)
    sums = np.zeros(runs, np.uint64)
    for j in range(n):
        sums += h[j : j + runs] * factors[j]
    text = words.text_of()
    whole = np.flatnonzero(text[:runs] == text[n - 1 : n - 1 + runs]) if runs else np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    rest = np.zeros(len(short), np.uint64)
    for j in range(n - 1):
        there = counts[short] > j
        rest[there] += h[first[short][there] + j] * factors[j]
    of = np.concatenate([text[whole], short])
    key = np.concatenate([mix(sums[whole] + np.uint64(n)), mix(rest + counts[short].astype(np.uint64))])
    return of, key


def distinct_pairs(of: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) in order."""
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
    return of[new], key[new]
