"""Sparse suffixes for finding repeated windows: anchors, marks, records, and the window test.

Both duplicate removers ask of every window of W consecutive units (bytes or words) whether it also
occurs elsewhere. Sorting one suffix per unit would multiply the corpus; here suffixes start only
at *anchors*. A window's anchor is the first of the smallest hashes among its k-unit grams, so
equal windows have equal anchors at equal offsets, and every window has one. About 2/(W-k+2) of
the units are anchors. With the anchor's right context (at most W units) and left context (at most
W-k), a window at offset d before the anchor occurs twice exactly if two records share W-d units to
the right and d units to the left.

Steps, each a Spark job over blocks of whole documents:

1. ``blocks``    texts are packed into blocks, stored once in the shared folder.
2. ``marks``     hashes of anchor grams are grouped; a gram in one place only cannot belong to a
                 repeat, and one bit per gram goes back to its block.
3. ``join_marks`` hands the bits to the blocks, which then send out records of the other anchors
                 (see the two operators).
4. ``window_masks`` tests the windows of sorted records; covered ranges go back to the blocks.

A block sends equal records once, so a group of copies, however large, costs a part of the
exchange at most one record per block and place. Groups are split by gram hash into
``parts_for(...)`` parts of bounded size: a gram's records are at most one per block and context.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varstrip.llm import text as tx
from varstrip.llm.store import written

BLOCK_BYTES = 8 << 20
# Text per part of an exchange, in bytes.
PART_BYTES = 4 << 20
GRAM_BYTES = 6  # of a gram's hash that travel; a chance agreement only costs a needless record

BLOCKS = "block long, doc_ids array<long>, keys array<long>, offsets array<long>, data binary"


class Units(NamedTuple):
    """Units of a slice: their hashes' prefix sums, their bytes in a record, documents' first units."""

    sums: np.ndarray
    rows: np.ndarray  # (units, bytes per unit), big-endian
    first: np.ndarray


class Shape(NamedTuple):
    """Window and gram length in units, and how units are read from a slice of text."""

    window: int
    gram: int
    width: int
    units: Callable[[np.ndarray, np.ndarray], Units]

    @property
    def span(self) -> int:
        return self.window - self.gram + 1


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.int64(len(a.tobytes())).tobytes() + a.tobytes() for a in arrays]))


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for s in tx.slices(batch.column(1), BLOCK_BYTES):
            data = zstandard.ZstdCompressor(level=3).compress(s.data.tobytes())
            row = (block, batch.column(0)[s.rows].to_pylist(), tx.text_keys(batch.column(1)[s.rows]), s.offsets.tolist(), data)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["block", "doc_ids", "keys", "offsets", "data"])
            block += 1


def blocks(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, text) packed into blocks, stored; the text is compressed here, once.

    ``keys`` are hashes of the texts, to find rows of ``documents`` again.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(rows.mapInArrow(_block_batches, BLOCKS), "blocks", "none")


def parts_for(stored: DataFrame) -> int:
    """Parts of an exchange, so that each has ``PART_BYTES`` of the text behind it."""
    size = stored.agg(F.sum(F.get("offsets", F.size("offsets") - 1))).first()[0] or 0
    return max(1, -(-size // PART_BYTES))


class Block(NamedTuple):
    block: int
    doc_ids: list
    offsets: np.ndarray
    data: np.ndarray


def opened(batch: pa.RecordBatch, i: int) -> Block:
    data = zstandard.ZstdDecompressor().decompress(batch.column("data")[i].as_py(), max_output_size=1 << 40) if batch.column("data")[i].as_py() else b""
    return Block(batch.column("block")[i].as_py(), batch.column("doc_ids")[i].as_py(), np.asarray(batch.column("offsets")[i].as_py(), np.int64), np.frombuffer(data, np.uint8))


class Anchors(NamedTuple):
    """Anchors of a slice: unit places, first and last window that they anchor, gram hashes."""

    place: np.ndarray
    low: np.ndarray
    high: np.ndarray
    gram: np.ndarray


def anchors(u: Units, shape: Shape) -> Anchors:
    """The anchor of every window, as one entry per run of windows with the same anchor."""
    group, rank = tx.runs(np.maximum(0, np.diff(u.first) - shape.window + 1))
    if not len(group):
        empty = np.zeros(0, np.int64)
        return Anchors(empty, empty, empty, np.zeros(0, np.uint64))
    window = u.first[group] + rank
    starts = np.arange(len(u.sums) - shape.gram)
    grams = tx.range_hashes(u.sums, starts, starts + shape.gram)
    # Hash above, place below: the least is the leftmost of the smallest. The same for all slices
    # but those of a single enormous document.
    bits = np.uint64(max(24, int(len(grams)).bit_length()))
    low = (grams >> bits << bits) | starts.astype(np.uint64)
    reach = 1
    while 2 * reach <= shape.span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < shape.span:
        low = np.minimum(low[: len(low) - (shape.span - reach)], low[shape.span - reach :])
    chosen = (low[window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (group[1:] != group[:-1])]))
    last = np.append(fresh[1:], len(window)) - 1
    return Anchors(chosen[fresh], window[fresh], window[last], grams[chosen[fresh]])


def slices_of(b: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Runs of a block's documents: byte base, bytes, offsets, number of the first document."""
    low, n = 0, len(b.offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(b.offsets, b.offsets[low] + tx.SLICE_BYTES // 2, "right")) - 1)
        base = int(b.offsets[low])
        yield base, b.data[base : b.offsets[high]], b.offsets[low : high + 1] - base, low
        low = high


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    return ((grams >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def _sent_grams(b: Block, shape: Shape, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of a block by (part, gram), whether each comes more than once, and parts."""
    grams = np.concatenate([anchors(shape.units(d, o), shape).gram for _, d, o, _ in slices_of(b)] or [np.zeros(0, np.uint64)])
    grams, counts = np.unique(grams, return_counts=True)
    part = part_of(grams, parts)
    order = np.argsort(part, kind="stable")
    return grams[order], counts[order] > 1, part[order]


_MASK = np.uint64((1 << (8 * GRAM_BYTES)) - 1)


def marks(stored: DataFrame, shape: Shape, parts: int) -> DataFrame:
    """For every block and part, one bit per distinct gram: does another block have it too?"""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = opened(batch, i)
                grams, _, part = _sent_grams(b, shape, parts)
                short = (grams & _MASK).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :GRAM_BYTES]
                own, at = np.unique(part, return_index=True)
                rows = [short[x:y].tobytes() for x, y in zip(at, [*at[1:], len(part)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([b.block] * len(own), pa.int64()), pa.array(rows, pa.binary())], names=["part", "block", "grams"])

    def match(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.uint8).reshape(-1, GRAM_BYTES) for x in table.column("grams").to_pylist()]
        grams = np.zeros((sum(map(len, rows)), 8), np.uint8)
        grams[:, :GRAM_BYTES] = np.concatenate(rows)
        _, same, counts = np.unique(grams.view("<u8").ravel(), return_inverse=True, return_counts=True)
        twice = counts[same] > 1
        cut = np.cumsum([len(r) for r in rows])[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(twice, cut)]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})

    sent = stored.select("block", "offsets", "doc_ids", "data").mapInArrow(send, "part long, block long, grams binary")
    return sent.groupBy("part").applyInArrow(match, "block long, part long, bits binary")


def join_marks(stored: DataFrame, marked: DataFrame) -> DataFrame:
    """Blocks with the bits of all their parts, in the order in which they sent them."""
    own = marked.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "bits"))).alias("marks"))
    return stored.join(own, "block", "left")


class Records(NamedTuple):
    """Records of a block in the order of (part, right, left, offsets): one per context.

    ``place`` is the anchor's unit within the block, ``doc`` the document's number in the block;
    windows of the record lie ``near`` to ``far`` units before it. ``rows`` holds the bytes of the
    right context, padded to W units, then those of the left one, nearest unit first.
    """

    part: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    near: np.ndarray
    far: np.ndarray
    rows: np.ndarray


def records(b: Block, marked: list | None, shape: Shape, parts: int) -> tuple[Records, np.ndarray, np.ndarray]:
    """Records of the anchors whose gram comes twice, equal ones included, the earliest first.

    Also returns which records repeat the one before them, and the first unit of every document.
    """
    found, unit_base, first = [], 0, [np.zeros(1, np.int64)]
    per_slice = []
    for _, data, offsets, doc in slices_of(b):
        u = shape.units(data, offsets)
        per_slice.append((anchors(u, shape), u, unit_base, doc))
        first.append(u.first[1:] + unit_base)
        unit_base += int(u.first[-1])
    grams = np.concatenate([a.gram for a, *_ in per_slice] or [np.zeros(0, np.uint64)])
    distinct, counts = np.unique(grams, return_counts=True)
    part = part_of(distinct, parts)
    order = np.argsort(part, kind="stable")
    sizes = np.bincount(part, minlength=1) if len(part) else np.zeros(0, np.int64)
    sizes = sizes[sizes > 0]
    bits = [np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=int(n)) for m, n in zip(marked or [], sizes, strict=True)]
    shared = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    live = np.sort(distinct[order][shared | (counts[order] > 1)])
    for a, u, base, doc in per_slice:
        at = np.minimum(np.searchsorted(live, a.gram), max(0, len(live) - 1))
        keep = np.flatnonzero(live[at] == a.gram) if len(live) else np.zeros(0, np.int64)
        place, near, far = a.place[keep], a.place[keep] - a.high[keep], a.place[keep] - a.low[keep]
        right, left = np.arange(shape.window), np.arange(1, shape.span)
        n = len(u.rows)
        rows = np.zeros((len(keep), shape.window + shape.span - 1, shape.width), np.uint8)
        if len(keep):
            rows[:, : shape.window] = u.rows[np.minimum(place[:, None] + right, n - 1)]
            rows[:, : shape.window][right >= (shape.window - near)[:, None]] = 0
            rows[:, shape.window :] = u.rows[np.maximum(place[:, None] - left, 0)]
            rows[:, shape.window :][left > far[:, None]] = 0
        number = np.searchsorted(u.first, place, "right") - 1 + doc
        found.append((part_of(a.gram[keep], parts), number, place + base, near, far, rows.reshape(len(keep), (shape.window + shape.span - 1) * shape.width)))
        del u
    if not found:
        empty = np.zeros(0, np.int64)
        return Records(empty, empty, empty, empty, empty, np.zeros((0, (shape.window + shape.span - 1) * shape.width), np.uint8)), np.zeros(0, bool), np.zeros(1, np.int64)
    part, doc, place, near, far, rows = (np.concatenate(x) for x in zip(*found, strict=True))
    # Earliest first among equal ones: by doc_id, then by place.
    ids = np.array([-(2**63) if x is None else x for x in b.doc_ids], np.int64)
    early = np.lexsort((place, ids[doc]))
    part, doc, place, near, far, rows = (x[early] for x in (part, doc, place, near, far, rows))
    head = np.stack([part >> 24, part >> 16, part >> 8, part], axis=1).astype(np.uint8)
    keyed = np.concatenate([head, rows, near[:, None].astype(np.uint8), far[:, None].astype(np.uint8)], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"V{keyed.shape[1]}").ravel(), kind="stable")
    keyed = keyed[order]
    same = np.zeros(len(order), bool)
    same[1:] = (keyed[1:] == keyed[:-1]).all(axis=1)
    return Records(part[order], doc[order], place[order], near[order], far[order], rows[order]), same, np.concatenate(first)


def common(rows: np.ndarray, width: int) -> np.ndarray:
    """Units that each row shares with the row before it from the left end on."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1) // width, rows.shape[1] // width)
    return out


def window_masks(shared_right: np.ndarray, left: np.ndarray, near: np.ndarray, far: np.ndarray, rank: np.ndarray | None, shape: Shape) -> np.ndarray:
    """Bit d of a record is set if its window d units before the anchor is a repeat.

    Records come in the order of their right contexts; ``shared_right`` is what each shares with
    the one before. Cutting this order where less than W-d units are shared gives the records that
    agree to the right (the nodes of depth W-d of the suffix tree), and likewise to the left. With
    ``rank`` all but the earliest of equal windows are repeats, without it all of them.
    """
    n = len(near)
    mask = np.zeros(n, np.uint64)
    order = np.argsort(np.ascontiguousarray(left).view(f"V{left.shape[1]}").ravel(), kind="stable") if left.shape[1] else np.arange(n)
    shared_left = common(left[order], shape.width)
    by_rank = np.argsort(rank, kind="stable") if rank is not None else np.arange(n)
    for d in range(shape.span):
        to_right = np.cumsum(shared_right < shape.window - d).astype(np.uint64)
        to_left = np.empty(n, np.uint64)
        to_left[order] = np.cumsum(shared_left < d) if d else 0
        active = by_rank[((near <= d) & (far >= d))[by_rank]]
        if len(active) < 2:
            continue
        key = (to_right[active] << np.uint64(32)) | to_left[active]
        inner = np.argsort(key, kind="stable")
        key, who = key[inner], active[inner]
        again = key[1:] == key[:-1]
        hit = np.zeros(len(who), bool)
        hit[1:] = again
        if rank is None:
            hit[:-1] |= again
        mask[who[hit]] |= np.uint64(1 << d)
    return mask


def ranges(mask: np.ndarray, place: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, start, end) of the units covered by the windows of the masks' bits."""
    opens, closes = mask & ~(mask << np.uint64(1)), mask & ~(mask >> np.uint64(1))
    found = []
    for bits in (opens, closes):
        who, d = [], []
        for k in range(shape.span):
            hit = np.flatnonzero((bits >> np.uint64(k)) & np.uint64(1))
            who.append(hit)
            d.append(np.full(len(hit), k))
        who, d = np.concatenate(who), np.concatenate(d)
        order = np.lexsort((d, who))
        found.append((who[order], d[order]))
    (who, nearest), (_, farthest) = found
    return who, place[who] - farthest, place[who] - nearest + shape.window


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same places as disjoint ranges in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[fresh], reach[np.append(fresh[1:], len(starts)) - 1]


def covered_by(rows: list[bytes] | None, n: int) -> np.ndarray:
    """Units of a block that the packed ranges cover."""
    pairs = [unpacked(r, np.uint32, np.uint32) for r in rows or []]
    if not pairs:
        return np.zeros(n, bool)
    return tx.covered(*(np.concatenate(x).astype(np.int64) for x in zip(*pairs, strict=True)), n)


SENT = "part long, block long, whole binary, run binary"
COVERED = "block long, ranges binary"


def exchange(stored: DataFrame, shape: Shape, send_run: Callable, match: Callable) -> DataFrame:
    """Blocks with the ranges of their repeated units, column ``ranges``.

    ``send_run(records, doc_ids)`` packs a block's records of one part; ``match(rows, shape)``
    takes (block, run) pairs of a part and yields (block, starts, ends). A record that equals an
    earlier one of its block is a repeat as a whole; its range goes along without being sorted.
    With ``rank`` unused by the operator the earliest equal one is a repeat too.
    """
    parts = parts_for(stored)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = opened(batch, i)
                r, same, _ = records(b, batch.column("marks")[i].as_py(), shape, parts)
                whole = same.copy()
                if send_run.all_copies:
                    whole[:-1] |= same[1:]
                starts, ends = merged((r.place - r.far)[whole], (r.place - r.near + shape.window)[whole])
                local = packed(starts.astype(np.uint32), ends.astype(np.uint32)) if len(starts) else None
                kept = np.flatnonzero(~same)
                own, at = np.unique(r.part[kept], return_index=True)
                runs = [send_run(Records(*[x[kept[lo:hi]] for x in r]), b.doc_ids, shape) for lo, hi in zip(at, [*at[1:], len(kept)], strict=True)]
                # The local ranges ride with one of the block's runs.
                out = [own.tolist(), [b.block] * len(own), [local] + [None] * (len(own) - 1) if len(own) else [], runs]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "whole", "run"])

    def group(table: pa.Table) -> pa.Table:
        got: dict[int, list[bytes]] = {}
        names = table.column("block").to_pylist()
        for block, whole in zip(names, table.column("whole").to_pylist(), strict=True):
            if whole is not None:
                got.setdefault(block, []).append(whole)
        for block, starts, ends in match(list(zip(names, table.column("run").to_pylist(), strict=True)), shape):
            starts, ends = merged(starts, ends)
            got.setdefault(block, []).append(packed(starts.astype(np.uint32), ends.astype(np.uint32)))
        rows = [(block, r) for block, rs in got.items() for r in rs]
        return pa.table({"block": pa.array([x[0] for x in rows], pa.int64()), "ranges": pa.array([x[1] for x in rows], pa.binary())})

    sent = join_marks(stored, marks(stored, shape, parts)).mapInArrow(send, SENT)
    found = sent.groupBy("part").applyInArrow(group, COVERED)
    found = found.groupBy("block").agg(F.collect_list("ranges").alias("ranges"))
    return stored.join(found, "block", "left")
