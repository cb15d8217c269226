"""Suffix-array dedup: remove every byte of a 100-byte string that also starts earlier.

A sparse suffix array over anchors (see ``anchors``) is built by distributed merge sort that never
looks at a common prefix twice:

* every block sorts the suffixes of its anchors into runs, one per part, and sends them front-coded:
  of each suffix only what it does not share with the one before;
* a part merges the runs of all blocks with a loser tree whose nodes remember how much each waiting
  suffix shares with the last one put out. Suffixes with different values are ordered without being
  looked at; equal values are compared from there on only;
* the merged order comes with the common prefixes of neighbours, from which the repeated windows of
  every suffix follow at once.

Order of occurrences: by ``doc_id`` (NULL first), then start; rows with the same ``doc_id`` (also
repeated rows) follow each other in the order of the stored blocks.

Defined results: a NULL or empty text has no bytes and keeps none; a text of any length is one
document; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from varstrip.llm import anchors as an
from varstrip.llm import text as tx

LENGTH, GRAM = 100, 40


def byte_units(data: np.ndarray, offsets: np.ndarray) -> an.Units:
    return an.Units(tx.prefix_sums(tx.VALUES[data]), data.reshape(-1, 1), offsets)


SHAPE = an.Shape(LENGTH, GRAM, 1, byte_units)


def front_coded(r: an.Records, doc_ids: list, shape: an.Shape) -> bytes:
    """A sorted run: shared lengths, the rest of each suffix, left contexts and whereabouts."""
    right = r.rows[:, : shape.window]
    shared = an.common(right, 1)
    size = shape.window - r.near
    at = np.arange(shape.window)
    rest = right[(at >= shared[:, None]) & (at < size[:, None])]
    left = r.rows[:, shape.window :][np.arange(1, shape.span) <= r.far[:, None]]
    ids = np.array([-(2**63) if x is None else x for x in doc_ids], np.int64)[r.doc]
    return an.packed(shared.astype(np.uint8), r.near.astype(np.uint8), r.far.astype(np.uint8), r.place.astype(np.uint32), ids, rest, left)


front_coded.all_copies = False


def decoded(run: bytes, shape: an.Shape) -> tuple[np.ndarray, ...]:
    """(shared, near, far, place, doc_id, right, left) of a run, contexts as padded rows."""
    shared, near, far, place, ids, rest, left_bytes = an.unpacked(run, np.uint8, np.uint8, np.uint8, np.uint32, np.int64, np.uint8, np.uint8)
    at = np.arange(shape.window)
    size = shape.window - near.astype(np.int64)
    right = np.zeros((len(near), shape.window), np.uint8)
    right[(at >= shared[:, None]) & (at < size[:, None])] = rest
    # A shared prefix is that of the row above, up to its own end.
    for i in np.flatnonzero(shared).tolist():
        right[i, : shared[i]] = right[i - 1, : shared[i]]
    left = np.zeros((len(near), shape.span - 1), np.uint8)
    left[np.arange(1, shape.span) <= far[:, None]] = left_bytes
    return shared.astype(np.int64), near.astype(np.int64), far.astype(np.int64), place.astype(np.int64), ids, right, left


class LoserTree:
    """Merge sorted runs of equally long byte strings by their known common prefixes.

    ``known[i]`` of a run is what item i shares with item i-1 of the run. A waiting item carries
    what it shares with the last item put out. Of two, the one that shares more is smaller; if
    they share the same, they are compared from there on, and the loser's value becomes what it
    shares with the winner, which is the next item put out on its path.
    """

    def __init__(self, runs: list[tuple[bytes, list[int]]], size: int):
        self.size = size
        self.runs = runs
        self.count = [len(known) for _, known in runs]
        k = 1
        while k < len(runs):
            k *= 2
        self.leaves = k
        self.index = [0] * k
        self.shared = [0] * k  # of each run's waiting item with the last one put out
        self.item: list[bytes | None] = [runs[j][0][:size] if j < len(runs) and self.count[j] else None for j in range(k)]
        self.compared = 0
        self.loser = [0] * k
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.leaves:
            return node - self.leaves
        a, b = self._build(2 * node), self._build(2 * node + 1)
        winner, self.loser[node] = self._play(a, b)
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two waiting items; an exhausted run loses, ties go to the first run."""
        x, y = self.item[a], self.item[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = self.shared[a], self.shared[b]
        if p > q:
            return a, b
        if p < q:
            return b, a
        self.compared += 1
        if x == y:
            self.shared[max(a, b)] = self.size
            return (a, b) if a < b else (b, a)
        u, v = x[p:], y[p:]
        differ = int.from_bytes(u, "big") ^ int.from_bytes(v, "big")
        same = p + len(u) - (differ.bit_length() + 7) // 8
        if u < v:
            self.shared[b] = same
            return a, b
        self.shared[a] = same
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, index, shared with the item before) in order."""
        item, shared, loser, play, size = self.item, self.shared, self.loser, self._play, self.size
        while item[self.winner] is not None:
            run = self.winner
            i = self.index[run]
            yield run, i, shared[run]
            i += 1
            self.index[run] = i
            if i < self.count[run]:
                item[run] = self.runs[run][0][i * size : (i + 1) * size]
                shared[run] = self.runs[run][1][i]
            else:
                item[run] = None
            node = (run + self.leaves) >> 1
            winner = run
            while node:
                other = loser[node]
                # Most games are settled by the values alone.
                if item[winner] is not None and item[other] is not None and shared[winner] != shared[other]:
                    if shared[other] > shared[winner]:
                        winner, loser[node] = other, winner
                else:
                    winner, loser[node] = play(winner, other)
                node >>= 1
            self.winner = winner


def merge_part(rows: list[tuple[int, bytes]], shape: an.Shape) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Merge a part's runs and give the ranges of repeated windows, block by block."""
    runs = [decoded(run, shape) for _, run in rows]
    tree = LoserTree([(r[5].tobytes(), r[0].tolist()) for r in runs], shape.window)
    base = np.cumsum([0, *[len(r[1]) for r in runs]])
    order = np.fromiter((x for run, i, shared in tree for x in (base[run] + i, shared)), np.int64).reshape(-1, 2)
    near, far, place, ids, left = (np.concatenate([r[k] for r in runs])[order[:, 0]] for k in (1, 2, 3, 4, 6))
    block = np.repeat([b for b, _ in rows], np.diff(base))[order[:, 0]]
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((place, block, ids))] = np.arange(len(order))
    mask = an.window_masks(order[:, 1], left, near, far, rank, shape)
    who, starts, ends = an.ranges(mask, place, shape)
    owner = block[who]
    for b in np.unique(owner):
        yield int(b), starts[owner == b], ends[owner == b]


CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cleaned(emit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = an.opened(batch, i)
                gone = an.covered_by(batch.column("ranges")[i].as_py(), len(b.data))
                n = np.diff(b.offsets)
                total = np.concatenate([[0], np.cumsum(gone)])
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                edges = b.offsets[:-1][n > 0]
                opens[edges] = gone[edges]
                spans = np.concatenate([[0], np.cumsum(opens)])
                kept = b.data[~gone].tobytes()
                left = b.offsets - total[b.offsets]
                texts = [emit(kept[x:y]) for x, y in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(np.diff(total[b.offsets]), pa.int64()), pa.array(np.diff(spans[b.offsets]), pa.int64()), pa.array(texts)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


def deduplicated(documents: DataFrame) -> DataFrame:
    """Every document with what is left of it: doc_id, n_bytes, n_removed, n_spans, kept (bytes)."""
    found = an.exchange(an.blocks(documents), SHAPE, front_coded, merge_part)
    return found.mapInArrow(_cleaned(lambda x: x), CLEANED)


def op2(documents: DataFrame) -> DataFrame:
    """The contract's digest of ``deduplicated``."""
    found = an.exchange(an.blocks(documents), SHAPE, front_coded, merge_part)
    out = found.mapInArrow(_cleaned(lambda x: hashlib.sha256(x).hexdigest()), CLEANED.replace("kept binary", "kept string"))
    return out.withColumnRenamed("kept", "kept_sha256")
