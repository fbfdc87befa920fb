"""Words of UTF-8 texts and their 64-bit hashes, by whole arrays of bytes.

A word is a run of bytes that a table marks. Bytes above 0x7F always belong to words, so a
word of bytes is a word of code points. Hashes are polynomials modulo 2**64 over the bytes,
read off running sums and then mixed: the cost is a few passes over the bytes, whatever the
number of words. Long texts go in pieces that end between words, so that the scratch arrays
stay at a few tens of MB.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes per piece; the scratch arrays of a piece take about 60 times this.
PIECE = 1 << 18
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so they have inverses modulo 2**64


def byte_table(separators: list[tuple[int, int]]) -> np.ndarray:
    """True for each byte value in no (first, last) range."""
    table = np.ones(256, dtype=bool)
    for first, last in separators:
        table[first : last + 1] = False
    return table


#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text in which A-Z is lower-cased.
ALNUM = byte_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Words `[^\x20\x09-\x0D]+`.
UNBLANK = byte_table([(0x20, 0x20), (0x09, 0x0D)])


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, b in ((up, base), (down, inverse)):
        out[0] = 1
        out[1:] = b
        np.cumprod(out, out=out)
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = table[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(_BASE, 4 * PIECE) if len(data) <= 4 * PIECE else _powers(_BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def pieces(data: np.ndarray, table: np.ndarray):
    """(offset, piece) with each cut at a byte between words; a single word longer than a piece stays whole."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data):
            gaps = np.flatnonzero(~table[data[end : end + PIECE]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + PIECE, len(data))
        yield at, data[at:end]
        at = end


def words(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in an array of bytes of any length."""
    found = []
    for at, piece in pieces(data, table):
        s, e = spans(piece, table)
        found.append((s + at, e + at, hash_spans(piece, s, e)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` hashes, in order; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= np.uint64(_WORD_BASE)
        out += hashes[i : i + n]
    return mix(out)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """A copy in which A-Z is lower-cased."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] |= 32
    return out


def texts(column: pa.Array):
    """The bytes of each text of an Arrow column as an array, None for null; nothing is copied."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from texts(chunk)
        return
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i, good in enumerate(valid):
        yield data[offsets[i] : offsets[i + 1]] if good else None


def batched(column: pa.Array, size: int = PIECE):
    """Runs of texts of about ``size`` bytes: (first row, arrays); a longer text is alone in its run."""
    run, at, held = [], 0, 0
    for i, data in enumerate(texts(column)):
        n = 0 if data is None else len(data)
        if run and held + n > size:
            yield at, run
            run, at, held = [], i, 0
        run.append(data)
        held += n
    if run:
        yield at, run


def run_words(run: list, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a run of texts at once: (joined bytes, starts, ends, hashes, bounds).

    Text i of the run has the words bounds[i] up to bounds[i + 1].
    """
    gap = np.array([10], np.uint8)  # a newline is between words in every table here
    parts = [x for data in run for x in ((data if data is not None else gap[:0]), gap)]
    joined = np.concatenate(parts)
    if lower:
        joined = lower_bytes(joined)
    s, e, h = words(joined, table)
    ends = np.cumsum([0 if data is None else len(data) for data in run]) + np.arange(len(run))
    return joined, s, e, h, np.concatenate([[0], np.searchsorted(s, ends)])


class Lookup:
    """Positions of 64-bit hashes in a sorted array, by their top bits and a few probes."""

    def __init__(self, ordered: np.ndarray):
        self.ordered = ordered
        self.shift = np.uint64(64 - max(8, int(len(ordered)).bit_length() + 2))
        slots = (ordered >> self.shift).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange((1 << int(64 - self.shift)) + 1))

    def find(self, values: np.ndarray) -> np.ndarray:
        """The position of each value, or -1."""
        out = np.full(len(values), -1, np.int64)
        if not len(self.ordered) or not len(values):
            return out
        slot = (values >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.ordered[at[left]] == values[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out
