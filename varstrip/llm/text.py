"""Vectorised words and rolling hashes over the Arrow text columns that Spark hands to a task.

Everything here works on UTF-8 bytes of a bounded slice of documents. Both word classes used by
the operators are unions of byte classes, because every byte of a non-ASCII character is >= 0x80.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
# Documents of one slice: larger ones come alone.
SLICE_BYTES = 2 << 20


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    every = np.arange(256)
    alnum = ((every >= 0x30) & (every <= 0x39)) | ((every >= 0x41) & (every <= 0x5A)) | ((every >= 0x61) & (every <= 0x7A)) | (every >= 0x80)
    blank = (every == 0x20) | ((every >= 0x09) & (every <= 0x0D))
    values = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    folded = values.copy()
    folded[0x41:0x5B] = values[0x61:0x7B]
    return alnum, ~blank, values, folded


# Words of letters and digits (after lower-casing A-Z), and words between blanks.
ALNUM, SOLID, VALUES, FOLDED = _classes()


class Powers:
    """Powers of the hash base and of its inverse, grown when a longer slice comes."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            size = max(n, SLICE_BYTES + 1)
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, f, np.uint64)])) for f in (BASE, inverse))
        return cls.up[:n], cls.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the information of every bit over all bits."""
    h = h ^ (h >> np.uint64(33))
    h *= MIX1
    h ^= h >> np.uint64(29)
    h *= MIX2
    return h ^ (h >> np.uint64(32))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, shifted to exponent zero, are polynomial hashes of ranges."""
    up, _ = Powers.upto(max(1, len(values)))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range [start, end) of the units behind ``sums``; equal units, equal hash."""
    _, down = Powers.upto(len(sums))
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * MIX1)


def text_keys(column: pa.Array) -> list[int]:
    """Spark's ``xxhash64`` of every text, NULL included: with the id it names a row."""
    present = column.is_valid().to_pylist()
    data, at = raw(column)
    whole = data.tobytes()
    keys = [xxhash.xxh64_intdigest(whole[a:b], 42) if p else 42 for p, a, b in zip(present, at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


class Slice(NamedTuple):
    """Texts of some rows as one run of bytes; ``offsets`` has one more entry than rows."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; NULL is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a column into runs of rows of at most ``limit`` bytes; a longer text comes alone."""
    data, at = raw(column)
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield Slice(slice(low, high), data[at[low] : at[high]], at[low : high + 1] - at[low])
        low = high


class Words(NamedTuple):
    """Words of a slice: byte ranges, 64-bit hashes, and per row the index of its first word."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def word_ranges(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the words of every row, and the index of the first word of each row."""
    inside = table[data]
    n = len(data)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]  # a word never crosses documents
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool) -> Words:
    """Words of a slice with their hashes, A-Z folded to a-z on request."""
    starts, ends, first = word_ranges(data, offsets, table)
    sums = prefix_sums((FOLDED if fold else VALUES)[data])
    return Words(starts, ends, range_hashes(sums, starts, ends), first)


def runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: the group of every element, and its rank in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    rank = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
    return group, rank


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the ranges [start, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) > 0
