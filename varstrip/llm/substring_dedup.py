"""Substring dedup: remove every word of a 35-word window that also occurs anywhere else.

Suffixes at anchors (see ``anchors``) are split by prefixes into groups that fit in memory, and
each group's suffix tree is built and cut where its nodes are deep enough to be repeats:

* the hash of the first ``GRAM`` words deals suffixes to parts, so equal windows meet in one part;
* inside a part, prefixes are lengthened word by word until every group has at most ``GROUP``
  suffixes or the gram is used up (variable-length prefixes): a group is one subtree;
* a subtree is held as its sorted leaves and the depths of the nodes between neighbours. A node of
  depth W-d or more whose leaves also agree on d words to the left is a maximal repeat that covers
  a whole window, and all its leaves are removed.

Defined results: a NULL or empty text has no words; a text of any length is one document; repeated
rows and ids, also NULL, are documents like any other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from varstrip.llm import anchors as an
from varstrip.llm import text as tx

WINDOW, GRAM = 35, 10
GROUP = 20_000


def word_units(data: np.ndarray, offsets: np.ndarray) -> an.Units:
    w = tx.words(data, offsets, tx.SOLID, fold=False)
    return an.Units(tx.prefix_sums(w.hashes), w.hashes.astype(">u8").view(np.uint8).reshape(-1, 8), w.first)


SHAPE = an.Shape(WINDOW, GRAM, 8, word_units)


def coded(r: an.Records, doc_ids: list, shape: an.Shape) -> bytes:
    """Records of a part: distinct words once, contexts as numbers of words."""
    words, codes = np.unique(np.ascontiguousarray(r.rows).view(">u8"), return_inverse=True)
    codes = codes.reshape(len(r.place), shape.window + shape.span - 1).astype(np.uint16 if len(words) <= 1 << 16 else np.uint32)
    right = codes[:, : shape.window]
    shared = an.common(np.ascontiguousarray(right).view(np.uint8).reshape(len(right), -1), codes.itemsize)
    at = np.arange(shape.window)
    rest = right[(at >= shared[:, None]) & (at < shape.window - r.near[:, None])]
    left = codes[:, shape.window :][np.arange(1, shape.span) <= r.far[:, None]]
    return an.packed(words.astype(np.uint64), shared.astype(np.uint8), r.near.astype(np.uint8), r.far.astype(np.uint8), r.place.astype(np.uint32), rest.astype(np.uint32), left.astype(np.uint32))


coded.all_copies = True


def decoded(run: bytes, shape: an.Shape) -> tuple[np.ndarray, ...]:
    """(near, far, place, right, left) with word hashes; 0 where a context has ended."""
    words, shared, near, far, place, rest, left_codes = an.unpacked(run, np.uint64, np.uint8, np.uint8, np.uint8, np.uint32, np.uint32, np.uint32)
    at = np.arange(shape.window)
    right = np.zeros((len(near), shape.window), np.uint64)
    right[(at >= shared[:, None]) & (at < shape.window - near.astype(np.int64)[:, None])] = words[rest]
    for i in np.flatnonzero(shared).tolist():
        right[i, : shared[i]] = right[i - 1, : shared[i]]
    left = np.zeros((len(near), shape.span - 1), np.uint64)
    left[np.arange(1, shape.span) <= far[:, None]] = words[left_codes]
    return near.astype(np.int64), far.astype(np.int64), place.astype(np.int64), right, left


def prefix_groups(right: np.ndarray, most: int = GROUP, longest: int = GRAM) -> Iterator[np.ndarray]:
    """Split suffixes by prefixes that grow until a group is small or its gram is used up."""
    waiting = [(np.arange(len(right)), 0)]
    while waiting:
        rows, depth = waiting.pop()
        if len(rows) <= most or depth >= longest:
            yield rows
            continue
        order = np.argsort(right[rows, depth], kind="stable")
        key = right[rows[order], depth]
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        # Neighbouring small groups share a subtree of the shorter prefix.
        small: list[np.ndarray] = []
        for group in np.split(rows[order], cut):
            if len(group) > most:
                waiting.append((group, depth + 1))
                continue
            if small and sum(map(len, small)) + len(group) > most:
                yield np.concatenate(small)
                small = []
            small.append(group)
        if small:
            yield np.concatenate(small)


def match_part(rows: list[tuple[int, bytes]], shape: an.Shape) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ranges of the windows of a part that occur twice, block by block."""
    runs = [decoded(run, shape) for _, run in rows]
    near, far, place, right, left = (np.concatenate(x) for x in zip(*runs, strict=True))
    block = np.repeat([b for b, _ in rows], [len(r[0]) for r in runs])
    found = []
    for group in prefix_groups(right):
        keys = np.ascontiguousarray(right[group]).astype(">u8").view(np.uint8).reshape(len(group), -1)
        order = np.argsort(keys.view(f"V{keys.shape[1]}").ravel(), kind="stable")
        leaves = group[order]
        depths = an.common(keys[order], 8)
        sides = np.ascontiguousarray(left[leaves]).astype(">u8").view(np.uint8).reshape(len(leaves), -1)
        mask = an.window_masks(depths, sides, near[leaves], far[leaves], None, shape)
        who, starts, ends = an.ranges(mask, place[leaves], shape)
        found.append((block[leaves[who]], starts, ends))
    owner, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    for b in np.unique(owner):
        yield int(b), starts[owner == b], ends[owner == b]


CLEANED = "doc_id long, n_words long, n_removed long, kept string"


def _cleaned(emit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = an.opened(batch, i)
                starts, ends, first = tx.word_ranges(b.data, b.offsets, tx.SOLID)
                gone = an.covered_by(batch.column("ranges")[i].as_py(), len(starts))
                keep = np.flatnonzero(~gone)
                # Kept words with one blank behind each: gather the bytes, then cut per document.
                size = ends[keep] - starts[keep]
                group, rank = tx.runs(size + 1)
                at = starts[keep][group] + rank
                data = np.where(rank == size[group], np.uint8(0x20), b.data[np.minimum(at, max(0, len(b.data) - 1))]).tobytes() if len(keep) else b""
                place = np.concatenate([[0], np.cumsum(size + 1)])[np.searchsorted(keep, first)].tolist()
                texts = [emit(data[x : max(x, y - 1)]) for x, y in zip(place[:-1], place[1:], strict=True)]
                total = np.concatenate([[0], np.cumsum(gone)])[first]
                yield pa.RecordBatch.from_arrays([pa.array(b.doc_ids, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(total), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def deduplicated(documents: DataFrame) -> DataFrame:
    """Every document with the words left of it: doc_id, n_words, n_removed, kept."""
    found = an.exchange(an.blocks(documents), SHAPE, coded, match_part)
    return found.mapInArrow(_cleaned(lambda x: x.decode("utf-8", "replace")), CLEANED)


def op10(documents: DataFrame) -> DataFrame:
    """The contract's digest of ``deduplicated``."""
    found = an.exchange(an.blocks(documents), SHAPE, coded, match_part)
    out = found.mapInArrow(_cleaned(lambda x: hashlib.sha256(x).hexdigest()), CLEANED)
    return out.withColumnRenamed("kept", "kept_sha256")
