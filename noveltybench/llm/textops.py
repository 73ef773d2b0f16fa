"""Vectorised word hashing over Arrow text columns (numpy only, no Spark).

A text column arrives as one UTF-8 byte buffer with row offsets.  Everything
here works on that buffer, a few hundred kilobytes at a time, so memory stays
bounded whatever the batch or the length of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed in one step (fits the processor caches) and rows gathered into one slice.
SEGMENT_BYTES = 1 << 17
SLICE_BYTES = 1 << 21


def splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order.  Sorted and compared: numpy's own hashes integers, fifty times slower on millions."""
    ordered = np.sort(values)
    if len(ordered) < 2:
        return ordered
    new = np.empty(len(ordered), bool)
    new[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new]


_BYTE = splitmix(256, 11)
_NGRAM = int(splitmix(1, 13)[0]) | 1
_places = [splitmix(SEGMENT_BYTES * 2, 14)]

#: Byte tables: ASCII lower-casing and the word alphabets of the operators.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _place_factors(n: int) -> np.ndarray:
    """A pseudo-random factor for each place in a word, ``n`` at least; kept for the usual sizes."""
    if n <= len(_places[0]):
        return _places[0]
    table = splitmix(1 << (n - 1).bit_length(), 14)
    if len(table) <= SEGMENT_BYTES * 8:
        _places[0] = table
    return table


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; one long row may exceed it."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of alphabet bytes, and the words before each row (n+1 values)."""
    inside = alphabet[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True  # words never cross rows
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    good = inside[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[good], ends[good]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, equal for equal bytes wherever they stand.

    A sum of products of a byte's value and a factor of its place in the word.  Powers of one base as factors would
    make long words of a regular build collide modulo 2**64.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(int(np.searchsorted(ends, at + SEGMENT_BYTES, side="right")), i + 1)
        span = int(ends[j - 1] - at)
        s, e = starts[i:j] - at, ends[i:j] - at
        place = np.arange(span) - np.repeat(s, np.diff(s, append=span))
        total = np.empty(span + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[data[at : at + span]] * _place_factors(int((e - s).max()))[np.minimum(place, int((e - s).max()) - 1)], out=total[1:])
        out[i:j] = total[e] - total[s]
        i = j
    return mix(out)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes (len(words) - n + 1 values)."""
    count = max(len(words) - n + 1, 0)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(_NGRAM)
        out += words[k : k + count]
    return mix(out ^ np.uint64(n))


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``text_buffer`` with A-Z in lower case."""
    data, offsets = text_buffer(column)
    return LOWER[data], offsets


def row_shingles(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-word shingle hashes); fewer than ``n`` words are one shingle, none give none."""
    data, offsets = text_buffer(column)
    for first, last in slices(offsets):
        at = offsets[first : last + 1]
        part = LOWER[data[at[0] : at[-1]]]
        starts, ends, before = word_spans(part, at - at[0], NON_SPACE)
        words = word_hashes(part, starts, ends)
        grams = ngram_hashes(words, n)
        for row in range(first, last):
            a, b = before[row - first], before[row - first + 1]
            if b - a >= n:
                yield row, distinct(grams[a : b - n + 1])
            elif b > a:
                yield row, ngram_hashes(words[a:b], int(b - a))
            else:
                yield row, np.zeros(0, np.uint64)
