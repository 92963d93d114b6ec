"""Words, hashes and shingles of whole batches of texts, computed with NumPy on their UTF-8 bytes.

A word is a maximal run of bytes other than the six ASCII white space bytes, with A-Z lowered.
Null texts count as empty. Work is cut into groups of whole texts, so that temporary arrays stay
near ``CHUNK_BYTES`` times a small factor; one text longer than that makes a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a fixed bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; text ``i`` is ``bytes[offsets[i]:offsets[i + 1]]``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and n else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if n else np.zeros(1, np.int64)


def groups(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row count, bytes, offsets) of consecutive groups of whole texts."""
    data, offsets = texts_of(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def block_parts(sizes, body: bytes, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of consecutive groups of the texts, of the given sizes, that ``body`` joins."""
    data = np.frombuffer(body, np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    n, i = len(sizes), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Powers:
    """Powers of the hash base and of its inverse, kept between groups."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            self.up, self.down = np.full(n + 1, _BASE), np.full(n + 1, _INVERSE)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)
        return self.up, self.down


def prefix_hashes(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Sums that give the hash of ``data[i:j]`` as ``(sums[j] - sums[i]) * down[i]``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every word."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, text number) of every word, in order."""
    start, end, text = word_bounds(data, offsets)
    up, down = powers(len(data))
    sums = prefix_hashes(_LOWER[data], up)
    return mix((sums[end] - sums[start]) * down[start]), text


def shingles(word: np.ndarray, text: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of ``size`` words; a shorter text with words is one run."""
    counts = np.bincount(text, minlength=n_texts)
    out, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(word) >= size:
        h = np.zeros(len(word) - size + 1, np.uint64)
        for k in range(size):
            h = mix(h * np.uint64(3) + word[k : k + len(h)])
        whole = text[: len(h)] == text[size - 1 :]
        out, own = h[whole], text[: len(h)][whole]
    first = np.cumsum(counts) - counts
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        short = np.array([_fold(word[first[i] : first[i] + counts[i]], size) for i in few], np.uint64)
        out, own = np.concatenate([out, short]), np.concatenate([own, few])
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own


def _fold(word: np.ndarray, size: int) -> np.uint64:
    h = np.full(1, size - len(word), np.uint64)
    for k in range(len(word)):
        h = mix(h * np.uint64(3) + word[k : k + 1])
    return h[0]
