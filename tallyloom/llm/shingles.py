"""Words and five-word shingles of whole texts as 64-bit hashes, half a megabyte of text at a time.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return in the
UTF-8 form, A-Z lower-cased. Equal words have equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
WORDS = 5
SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_SHINGLE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose result bits depend on all given ones."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    found = _powers.get(name)
    if found is None or len(found) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), U(base & (2**64 - 1)))
        steps[0] = U(1)
        found = _powers[name] = np.multiply.accumulate(steps)
    return found


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows first to last (exclusive) in turn, about SLICE_BYTES of text each; one text is never divided."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and for each text the number of words before it (and after the last)."""
    gap = (data == 32) | ((data - np.uint8(9)) < 5)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = gap[1:]
    starts = np.flatnonzero(~gap & (before | cut[:-1]))
    ends = np.flatnonzero(~gap & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in turn, and for each text the number of words before it."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    starts, ends, counts = word_spans(data, offsets)
    low = data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)
    n = len(data) + 1
    sums = np.zeros(n, U)
    np.cumsum((low.astype(U) + U(1)) * _power("up", _BASE, n)[: n - 1], out=sums[1:])
    values = (sums[ends] - sums[starts]) * _power("down", pow(_BASE, -1, 2**64), n)[starts]
    return mix(values ^ ((ends - starts).astype(U) * U(0xC2B2AE3D27D4EB4F))), counts


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of five words, of the whole text if it has fewer, none without words."""
    offsets, data = buffers(column)
    for first, last in slices(offsets):
        own = offsets[first : last + 1]
        words, counts = word_hashes(data[own[0] : own[-1]], own - own[0])
        m = len(words) - WORDS + 1
        joined = mix(sum(words[i : i + m] * _SHINGLE[i] for i in range(WORDS))) if m > 0 else np.zeros(0, U)
        for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
            if b - a >= WORDS:
                found = np.sort(joined[a : b - WORDS + 1])
                keep = np.ones(len(found), bool)
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield found[keep]
            elif b > a:
                yield mix(np.sum(words[a:b] * _SHINGLE[: b - a], keepdims=True) + U(b - a))
            else:
                yield np.zeros(0, U)
