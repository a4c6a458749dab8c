"""Words, shingles and MinHash values of whole columns of texts, computed on byte buffers without a loop over words.

Hashes have 64 bits: a polynomial over the bytes of a word, mixed with its length. Two different shingles get one hash
with a chance of 2^-64. Buffers are cut into slices of whole documents, so that memory follows the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b"\t\n\x0b\x0c\r "
SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15
STEP = np.uint64(0xD6E8FEB86659FD93)


class Alphabet(NamedTuple):
    """Which bytes belong to words, and the value of each byte in a hash."""

    inside: np.ndarray
    value: np.ndarray


@cache
def alphabet(separators: bytes, fold_case: bool) -> Alphabet:
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    if fold_case:
        value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
    return Alphabet(inside, value)


def plain_words(fold_case: bool) -> Alphabet:
    """Words are runs of bytes other than ASCII white space."""
    return alphabet(SPACES, fold_case)


def letter_words() -> Alphabet:
    """Words are runs of ASCII letters and digits and of everything beyond ASCII; case does not count."""
    return alphabet(bytes(b for b in range(128) if not chr(b).isalnum()), True)


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(2 * SLICE, n)
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    if len(_powers[0]) > 8 * SLICE >= n:  # a very long document came by; do not hold on to its tables
        _powers[:] = [p[: 2 * SLICE].copy() for p in _powers]
        return powers(n)
    return _powers[0][:n], _powers[1][:n]


class Texts(NamedTuple):
    """Some neighbouring documents: the number of the first, their bytes, and where each begins and the last ends."""

    first: int
    data: np.ndarray
    begins: np.ndarray

    def __len__(self) -> int:
        return len(self.begins) - 1


def text_slices(column: pa.Array, size: int = SLICE) -> Iterator[Texts]:
    """Cut a column of texts into slices of about a megabyte, or of ``size`` bytes; a missing text is an empty one."""
    if not len(column):
        return
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(column))
        yield Texts(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


class Words(NamedTuple):
    """Hashes of words, where they begin and end in the bytes, and the first word of each document."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words(texts: Texts, letters: Alphabet) -> Words:
    data, begins = texts.data, texts.begins
    n = len(data)
    inside = letters.inside[data]
    cut = np.zeros(n + 1, bool)
    cut[begins] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:n]
    closes[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, inverse = powers(max(n, 1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(letters.value[data] * power[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * STEP)
    return Words(hashes, start, end, np.searchsorted(start, begins))


class Shingles(NamedTuple):
    """Hashes of shingles in order of documents, with repeats, and the first shingle of each document."""

    hashes: np.ndarray
    first: np.ndarray


def _chain(hashes: list[np.ndarray]) -> np.ndarray:
    joined = hashes[0]
    for h in hashes[1:]:
        joined = joined * STEP + h
    return mix(joined + np.uint64(len(hashes)))


def shingles(found: Words, size: int) -> Shingles:
    """Runs of ``size`` words; a document with fewer words has all of them as its only shingle, one without words none."""
    h, per_doc = found.hashes, np.diff(found.first)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    n = max(0, len(h) - size + 1)
    runs = _chain([h[j : n + j] for j in range(size)]) if n else np.zeros(0, np.uint64)
    whole = doc[:n] == doc[size - 1 :] if n else np.zeros(0, bool)
    runs, of = runs[whole], doc[:n][whole]
    short = np.flatnonzero((per_doc > 0) & (per_doc < size))
    if len(short):
        extra = [_chain([h[i : i + 1] for i in range(found.first[d], found.first[d + 1])]) for d in short]
        runs, of = np.concatenate([runs, *extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        runs, of = runs[order], of[order]
    return Shingles(runs, np.searchsorted(of, np.arange(len(per_doc) + 1)))


@cache
def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and summands of n hash functions on 32 bits."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def block_minima(hashes: np.ndarray, begins: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Least values of n hash functions over each block of shingles, as (blocks, n); no block may be empty."""
    multiply, add = hash_family(n, seed)
    out = np.empty((n, len(begins)), np.uint32)
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for first in range(0, len(begins), 4096):
        some = begins[first : first + 4096]
        stop = begins[first + 4096] if first + 4096 < len(begins) else len(folded)
        part = folded[some[0] : stop]
        for k in range(n):
            out[k, first : first + len(some)] = np.minimum.reduceat(_finish(part * multiply[k] + add[k]), some - some[0])
    return out.T


def _finish(v: np.ndarray) -> np.ndarray:
    """Bring low bits into play; a product alone keeps the order of nearby inputs."""
    v ^= v >> np.uint32(15)
    v *= np.uint32(0x2C1B3C6D)
    return v
