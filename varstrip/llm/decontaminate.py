"""Benchmark decontamination over a distributed positional inverted index.

Training documents are indexed in shards of whole documents: each shard stores, per term, the
sorted positions of its occurrences. A shard holds all terms of its documents, so a query meets
every shard once and nothing has to be shuffled by term: a term that fills a third of the corpus
is spread over all shards. Search starts from the postings of a phrase's rarest term in the shard
and intersects the offset-adjusted postings of the other terms, next rarest first.

A shard has at most ``text.SLICE_BYTES`` of text, or one longer document: hashing takes many times
that, and a worker keeps what it once took beside later stages. Terms are kept as 64-bit hashes. The benchmark is sent to the tasks in blocks of at most
``BLOCK_BYTES`` of text, one pass over the index per block, however large it is.

Defined results: a NULL text has no words; a document of any length stays in one shard; repeated
documents and repeated ``doc_id`` values (also NULL) keep one output row each; equal items count
once per ``item_id``, and a NULL ``item_id`` is written as ``null``; an empty benchmark hits
nothing; other columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrip.llm import text as tx
from varstrip.llm.rows import named
from varstrip.llm.store import written

WINDOW = 10
BLOCK_BYTES = 8 << 20
# Candidate places looked at together in a task.
PLACES = 1 << 20
INDEX = "shard long, doc_ids array<long>, keys array<long>, first array<int>, terms binary, starts binary, positions binary"
HITS = "shard long, row int, ranges array<struct<lo:int,hi:int>>, items array<string>"


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids = batch.column(0)
        for s in tx.slices(batch.column(1)):
            w = tx.words(s.data, s.offsets, tx.ALNUM, fold=True)
            order = np.argsort(w.hashes, kind="stable")
            ordered = w.hashes[order]
            fresh = np.ones(len(ordered), bool)
            fresh[1:] = ordered[1:] != ordered[:-1]
            starts = np.append(np.flatnonzero(fresh), len(ordered)).astype(np.uint32)
            # Positions of a term are stored as steps, which compress well.
            steps = order.astype(np.int64)
            steps[1:] -= np.where(fresh[1:], 0, order[:-1])
            row = [shard, ids[s.rows].to_pylist(), tx.text_keys(batch.column(1)[s.rows]), w.first.astype(np.int32).tolist(), ordered[fresh].tobytes(), starts.tobytes(), steps.astype(np.uint32).tobytes()]
            shard += 1
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _INDEX_TYPES, strict=True)], names=_INDEX_NAMES)


_INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_INDEX_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]


def build_index(documents: DataFrame) -> DataFrame:
    """Positional inverted index of ``documents`` (doc_id, text), stored in the shared folder."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(rows.mapInArrow(_index_batches, INDEX), "postings")


class Phrases(NamedTuple):
    """Distinct phrases of one length, and the items that contain each."""

    terms: np.ndarray
    item: np.ndarray
    item_start: np.ndarray


def phrases(texts: list[str | None], window: int = WINDOW) -> list[Phrases]:
    """Windows of ``window`` consecutive words of every text; a shorter text is one window."""
    data, offsets = tx.raw(pa.array(texts, pa.string()))
    w = tx.words(data, offsets, tx.ALNUM, fold=True)
    n = np.diff(w.first)
    length = np.minimum(n, window)
    out = []
    for size in np.unique(length[length > 0]):
        chosen = np.flatnonzero(length == size)
        which, at = tx.runs(n[chosen] - size + 1)
        rows = w.hashes[(w.first[chosen][which] + at)[:, None] + np.arange(size)]
        terms, same = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([same.ravel(), chosen[which]]), axis=1)
        out.append(Phrases(terms, pairs[1], np.searchsorted(pairs[0], np.arange(len(terms) + 1))))
    return out


class Shard(NamedTuple):
    terms: np.ndarray
    starts: np.ndarray
    positions: np.ndarray
    keys: np.ndarray
    first: np.ndarray


def open_shard(row: dict) -> Shard:
    """Postings of a stored shard; ``keys`` are (term, position) pairs in order."""
    terms = np.frombuffer(row["terms"], np.uint64)
    starts = np.frombuffer(row["starts"], np.uint32).astype(np.int64)
    positions = np.frombuffer(row["positions"], np.uint32).astype(np.int64)
    term = np.repeat(np.arange(len(terms)), np.diff(starts))
    total = np.cumsum(positions)
    before = np.concatenate([[0], total])[starts[:-1]] if len(terms) else total
    positions = total - before[term] if len(terms) else total
    return Shard(terms, starts, positions, (term << 32) | positions, np.asarray(row["first"], np.int64))


def _present(shard: Shard, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Phrases whose terms all occur in the shard, and the terms' places in its dictionary."""
    if not len(shard.terms):
        return np.zeros(0, np.int64), np.zeros((0, p.terms.shape[1]), np.int64)
    at = np.minimum(np.searchsorted(shard.terms, p.terms), len(shard.terms) - 1)
    live = np.flatnonzero((shard.terms[at] == p.terms).all(axis=1))
    return live, at[live]


def _blocks(weights: np.ndarray) -> Iterator[slice]:
    """Runs of phrases whose rarest postings together stay bounded."""
    ends = np.cumsum(weights)
    low = 0
    while low < len(weights):
        base = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + PLACES, "right")))
        yield slice(low, high)
        low = high


def exact(shard: Shard, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of every place where the terms of a phrase stand consecutively."""
    live, at = _present(shard, p)
    size = p.terms.shape[1]
    frequency = shard.starts[at + 1] - shard.starts[at]
    order = np.argsort(frequency, axis=1, kind="stable")
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    rarest = order[:, 0] if len(live) else np.zeros(0, np.int64)
    counts = frequency[np.arange(len(live)), rarest]
    for block in _blocks(counts):
        which, rank = tx.runs(counts[block])
        which = which + block.start
        start = shard.positions[shard.starts[at[which, rarest[which]]] + rank] - rarest[which]
        which, start = which[start >= 0], start[start >= 0]
        for j in range(1, size):
            if not len(which):
                break
            offset = order[which, j]
            key = (at[which, offset] << 32) | (start + offset)
            place = np.minimum(np.searchsorted(shard.keys, key), len(shard.keys) - 1)
            hit = shard.keys[place] == key
            which, start = which[hit], start[hit]
        inside = np.searchsorted(shard.first, start, "right") == np.searchsorted(shard.first, start + size - 1, "right")
        found.append((live[which[inside]], start[inside]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def near(shard: Shard, p: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place of its rarest term) where every other term lies within ``slop`` words.

    Order is free and a document boundary is never crossed.
    """
    live, at = _present(shard, p)
    frequency = shard.starts[at + 1] - shard.starts[at]
    order = np.argsort(frequency, axis=1, kind="stable")
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    counts = frequency[np.arange(len(live)), order[:, 0]] if len(live) else np.zeros(0, np.int64)
    for block in _blocks(counts):
        which, rank = tx.runs(counts[block])
        which = which + block.start
        place = shard.positions[shard.starts[at[which, order[which, 0]]] + rank]
        for j in range(1, p.terms.shape[1]):
            if not len(which):
                break
            doc = np.searchsorted(shard.first, place, "right") - 1
            low = np.maximum(place - slop, shard.first[doc])
            high = np.minimum(place + slop, shard.first[doc + 1] - 1)
            term = at[which, order[which, j]]
            next_one = np.searchsorted(shard.keys, (term << 32) | low)
            hit = (next_one < len(shard.keys)) & (shard.keys[np.minimum(next_one, len(shard.keys) - 1)] <= ((term << 32) | high))
            which, place = which[hit], place[hit]
        found.append((live[which], place))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _search_batches(block, slop: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, groups = block.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("shard", "first", "terms", "starts", "positions")}
                shard = open_shard(row)
                marks, pairs = [], []
                for p in groups:
                    which, start = exact(shard, p) if slop is None else near(shard, p, slop)
                    marks.append((start, start + (p.terms.shape[1] if slop is None else 1)))
                    group, rank = tx.runs(p.item_start[which + 1] - p.item_start[which])
                    doc = np.searchsorted(shard.first, start, "right") - 1
                    pairs.append(np.stack([doc[group], p.item[p.item_start[which[group]] + rank]]))
                starts, ends = (np.concatenate([m[k] for m in marks] or [np.zeros(0, np.int64)]) for k in (0, 1))
                if not len(starts):
                    continue
                hit = tx.covered(starts, ends, int(shard.first[-1]))
                pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
                out = []
                for doc in np.unique(pairs[0]):
                    low, high = shard.first[doc], shard.first[doc + 1]
                    own = hit[low:high]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).astype(np.int32)
                    ranges = [{"lo": lo, "hi": hi} for lo, hi in edge.reshape(-1, 2).tolist()]
                    out.append((row["shard"], int(doc), ranges, sorted({names[k] for k in pairs[1][pairs[0] == doc]})))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _HIT_TYPES, strict=True)], names=["shard", "row", "ranges", "items"])

    return run


_HIT_TYPES = [pa.int64(), pa.int32(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])), pa.list_(pa.string())]


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Documents of the index with the words and items hit: (shard, row, ranges, items).

    Exact phrases by default; with ``slop``, places whose other terms lie within so many words.
    One pass over the index for each block of benchmark items, so a document may come once per
    block. ``ranges`` holds the hit runs [lo, hi) as word numbers of the document.
    """
    spark = index.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string")).filter("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = None
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        if rows:
            sent = spark.sparkContext.broadcast(([r[0] for r in rows], phrases([r[1] for r in rows], window)))
            hits = index.select("shard", "first", "terms", "starts", "positions").mapInArrow(_search_batches(sent, slop), HITS)
            found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], HITS) if found is None else found


def _united(ranges: Column) -> Column:
    """Words covered by any of the sorted ranges [lo, hi)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(acc, r):
        new = F.greatest(F.lit(0), r["hi"] - F.greatest(r["lo"], acc["end"]))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["end"], r["hi"]).alias("end"))

    return F.aggregate(F.array_sort(ranges), start, step, lambda acc: acc["n"])


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, words hit by a benchmark window, and the items behind them.

    Columns: doc_id, key (of its text), n_words, n_hit, n_items, items (sorted), contaminated.
    """
    index = build_index(documents)
    hits = search(index, benchmark, window)
    # Only documents with hits get here; one met by several blocks has its ranges united.
    hits = hits.groupBy("shard", "row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"))
    hits = hits.select("shard", "row", _united(F.col("ranges")).alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"))
    docs = index.select("shard", "first", "keys", F.posexplode("doc_ids").alias("row", "doc_id"))
    docs = docs.select("shard", "row", "doc_id", F.get("keys", F.col("row")).alias("key"), (F.get("first", F.col("row") + 1) - F.get("first", F.col("row"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return docs.join(hits, ["shard", "row"], "left").select("doc_id", "key", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` without the contaminated ones, all columns kept."""
    bad = contamination(documents, benchmark, window).filter("contaminated").select(F.struct("doc_id", "key").alias("_name")).distinct()
    return named(documents).join(bad, "_name", "left_anti").select("_row.*")


def op1(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of ``contamination``."""
    out = contamination(documents, benchmark)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
