"""Vectorised text primitives shared by the corpus operators.

Everything works on flat UTF-8 buffers taken from Arrow columns, so that no per-word Python object is made. Chunks are
cut at row borders; a chunk holds at least one whole text, however long it is. Null texts count as empty.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def memo(f):
    """Keeps a function's results for the process. Unlike functools.cache it travels by value and takes no results along."""
    name = f"{f.__module__}.{f.__qualname__}"

    def kept(*args):
        store = sys.__dict__.setdefault("_placefabric_memo", {})
        if (name, *args) not in store:
            store[(name, *args)] = f(*args)
        return store[(name, *args)]

    return kept


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@memo
def byte_table(seed: int = 1) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * seed)) * np.uint64(_BASE))


@memo
def space_table() -> np.ndarray:
    """White space of the word pattern: U+0020 and U+0009 to U+000D."""
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


@memo
def mark_table() -> np.ndarray:
    """What separates words of ASCII letters, digits and all non-ASCII characters, in lower-cased text."""
    t = np.ones(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = False
    return t


@memo
def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


@memo
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(16, math.ceil(math.log2(max(n, 2) + 1))))


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums S with which span_hash gives the hash of any span of the symbols (unsigned 64-bit)."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols) + 1)[0][: len(symbols)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans [start, end); equal for equal contents wherever they stand."""
    with np.errstate(over="ignore"):
        down = powers(len(sums))[1]
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about so many bytes."""
    data, offsets = texts(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of its first word (rows + 1 entries). apart: the table of separating bytes, else white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = (space_table() if apart is None else apart)[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(before & ~space)
    return starts, np.flatnonzero(after & ~space) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and for each row the number of its first word."""
    if lower:
        data = lower_table()[data]
    starts, ends, first = word_spans(data, offsets, apart)
    return span_hash(prefix_hash(byte_table()[data]), starts, ends), first


def shingle_sets(words: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles; with fewer words the whole sequence is one shingle."""
    n = len(words)
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, n - width + 1), np.uint64)
        for j in range(width):
            total = total * np.uint64(0xA0761D6478BD642F) + words[j : n - width + 1 + j]
        total = mix(total)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                s = np.sort(total[a : b - width + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif b > a:
                x = np.uint64(b - a)
                for w in words[a:b]:
                    x = x * np.uint64(0xE7037ED1A0B428DB) + w
                yield mix(np.array([x]))
            else:
                yield total[:0]


def sorted_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in stable order of their keys (not negative), and the sorted keys."""
    bits = max(1, int(len(keys)).bit_length())
    if len(keys) and int(keys.max()).bit_length() + bits < 63:  # one sort of key and place together
        both = np.sort((keys << bits) | np.arange(len(keys)))
        return both & ((1 << bits) - 1), both >> bits
    order = np.argsort(keys, kind="stable")
    return order, keys[order]


def dense(hashes: np.ndarray) -> np.ndarray:
    """Numbers from 0 for 64-bit hashes in their order, equal for equal ones."""
    bits = np.uint64(max(1, len(hashes).bit_length()))
    order = (np.sort((hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    keys = hashes[order]
    new = keys[1:] != keys[:-1]
    if (new & (keys[1:] >> bits == keys[:-1] >> bits)).any():  # two that differ in their last bits alone
        return np.unique(hashes, return_inverse=True)[1]
    out = np.empty(len(hashes), np.int64)
    out[order] = np.cumsum(np.concatenate(([0], new))) if len(hashes) else 0
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of so many entries, from block-wise running minima."""
    n = len(x) - width + 1
    if width == 1 or n <= 0:
        return x[: max(n, 0)]
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
