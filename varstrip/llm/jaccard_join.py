"""N-gram Jaccard join by T-occurrence search.

Documents are sets of five-word shingles; two link if their similarity is at least ``NEED`` percent.

* Candidates share one of their *prefix* shingles. Shingles are put in one order for the whole
  corpus, rare ones first, by a counting sketch of fixed size over all documents; with a set of n
  shingles any partner must share one of the first n - ceil(0.75 n) + 1. A passage that many
  documents share stays out of their prefixes, while any order gives the same links.
* Prefix postings are dealt by shingle; those of a single document are dropped.
* Connected documents need no further comparison, so lists are not expanded into pairs. Each
  document is first compared with the first member of a list it shares most with. Then all pairs of
  a list that lie in different components and pass the length and position filters are compared, so
  no link between different components is lost. In a list with very many such pairs the members outside
  its largest component first meet one member of that and one of their own, then four times as many
  every round, until a round finds nothing new: a group of near copies is one component by then.
* Pairs whose *prints* differ too much are dropped before any set is made. A print has one bit per
  place that a set's shingles are hashed to: whether their number there is odd. Sets differ in at least
  as many shingles as their prints in bits, so no link is lost. Prints are stored by the first pass.
* A round makes the sets that it compares, and no others, where the texts lie, by a bitmap of ``FILTER``
  bits of the nodes; only sets are moved.
* A comparison is a T-occurrence search: the members of a block are indexed by shingle, and a query
  needs T occurrences in the lists of its own shingles. DivideSkip sets the L longest lists aside,
  merges the short ones with a heap, keeps members with T - L occurrences, and probes the long
  lists for those by binary search.

Equal sets within a block of documents are one node from the start, equal sets of different blocks
meet as candidates. Blocks of queries hold at most ``MEMBERS`` members, so a pivot of thousands of
near copies is searched by many tasks.

Defined results: a document without words has no shingles and is its own component; fewer than five
words make one shingle; repeated rows and ids are linked through their texts; a NULL ``doc_id``
counts as larger than any other and gets a NULL component if its component has no other id;
documents of any length are compared whole; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varstrip.llm import anchors as an
from varstrip.llm import text as tx
from varstrip.llm.bitmaps import bitmap, holds
from varstrip.llm.components import components, extended
from varstrip.llm.rows import named, one_of_each_name
from varstrip.llm.store import written

SHINGLE, NEED = 5, 75
SKETCH = 1 << 20  # counters of the sketch, whatever the corpus' size
CHUNKS = 64
SEEDS = 6  # postings per document that look for a partner in a round
MEMBERS = 256
SET_BYTES = 6
FILTER = 33_554_393  # a prime: nodes of different blocks share their low bits
CROSS = 4096  # pairs of different components that a list may have to be compared at once
LEAST_PRINT = 64  # bits of the shortest print; longer ones have a power of two, n to 2 n
MU = 0.02  # weight of a probe in DivideSkip's choice of L


class Sets(NamedTuple):
    """Distinct shingle sets of a block. ``node`` of a document is its set's number, or -1."""

    node: np.ndarray
    first: np.ndarray
    shingles: np.ndarray


def _slice_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) pairs of a slice, sorted and distinct."""
    w = tx.words(data, offsets, tx.SOLID, fold=True)
    n = np.diff(w.first)
    size = np.minimum(n, SHINGLE)
    doc, rank = tx.runs(np.where(n > 0, n - size + 1, 0))
    start = w.first[doc] + rank
    hashes = tx.range_hashes(tx.prefix_sums(w.hashes), start, start + size[doc])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[fresh], hashes[fresh]


def block_sets(b: an.Block) -> Sets:
    """The distinct sets of a block in the order in which they come up."""
    node = np.full(len(b.doc_ids), -1, np.int64)
    seen: dict[bytes, int] = {}
    kept = []
    for _, data, offsets, base in an.slices_of(b):
        doc, hashes = _slice_sets(data, offsets)
        edges = np.searchsorted(doc, np.arange(len(offsets)))
        for i in np.flatnonzero(np.diff(edges)).tolist():
            own = hashes[edges[i] : edges[i + 1]]
            number = seen.setdefault(own.tobytes(), len(seen))
            if number == len(kept):
                kept.append(own)
            node[base + i] = number
    return Sets(node, np.cumsum([0, *map(len, kept)]), np.concatenate(kept) if kept else np.zeros(0, np.uint64))


def rows_of(s: Sets) -> np.ndarray:
    """Row of its block at which each set comes first: the number that its node is known by."""
    number, row = np.unique(s.node, return_index=True)
    return row[number >= 0]


def parity_print(shingles: np.ndarray) -> bytes:
    """One bit per place: whether an odd number of shingles is hashed to it."""
    bits = max(LEAST_PRINT, 1 << (len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A print as it is with ``size`` bytes."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def needed(n, need: int = NEED):
    """Least overlap of a set of n shingles with any partner."""
    return -(-need * n // 100)


def overlap_needed(n, m, need: int = NEED):
    """Least overlap that makes sets of n and m shingles similar enough."""
    return -(-need * (n + m) // (100 + need))


_DOCS = pa.struct([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])
_PRINTS = pa.struct([("node", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])
COUNTED = "chunk int, counts binary, docs array<struct<doc_id:long,key:long,node:long,n:long>>, prints array<struct<node:long,n:long,bits:binary>>"


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["chunk", "counts", "docs", "prints"]
    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            b = an.opened(batch, i)
            s = block_sets(b)
            counts += np.bincount((s.shingles % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
            size = np.diff(s.first)
            keys = batch.column("keys")[i].as_py()
            nodes = [node_id(b.block, x) for x in rows_of(s).tolist()]
            docs = [{"doc_id": d, "key": h, "node": nodes[k] if k >= 0 else None, "n": int(size[k]) if k >= 0 else 0} for d, h, k in zip(b.doc_ids, keys, s.node.tolist(), strict=True)]
            prints = [{"node": x, "n": int(size[k]), "bits": parity_print(s.shingles[s.first[k] : s.first[k + 1]])} for k, x in enumerate(nodes)]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.binary()), pa.array([docs], pa.list_(_DOCS)), pa.array([prints], pa.list_(_PRINTS))], names=names)
    if counts.any():
        yield pa.RecordBatch.from_arrays([*chunks_of(counts), pa.array([None] * CHUNKS, pa.list_(_DOCS)), pa.array([None] * CHUNKS, pa.list_(_PRINTS))], names=names)


def chunks_of(counts: np.ndarray) -> list[pa.Array]:
    """A task's sketch as columns (chunk, counts)."""
    return [pa.array(range(CHUNKS), pa.int32()), pa.array([an.packed(x.astype(np.uint64)) for x in np.split(counts, CHUNKS)], pa.binary())]


def _summed(table: pa.Table) -> pa.Table:
    total = sum(an.unpacked(x, np.uint64)[0] for x in table.column("counts").to_pylist())
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def sketched(chunks: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches (chunk, counts)."""
    sums = chunks.groupBy("chunk").applyInArrow(_summed, "chunk int, counts binary").orderBy("chunk").collect()
    sketch = np.concatenate([np.frombuffer(r.counts, np.uint64) for r in sums]) if sums else np.zeros(SKETCH, np.uint64)
    return sketch.astype(np.int64)


def node_id(block: int, number: int) -> int:
    """A node of the link graph: blocks have a task's number above bit 32 and few rows below."""
    return ((block >> 32) << 40) | ((block & 0xFFFF) << 24) | number


def ordered(s: Sets, counts: np.ndarray) -> np.ndarray:
    """Shingles of every set in the order of the corpus: (sketched count, hash)."""
    group, _ = tx.runs(np.diff(s.first))
    return s.shingles[np.lexsort((s.shingles, counts[(s.shingles % np.uint64(SKETCH)).astype(np.int64)], group))]


def _posting_batches(sketch, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            for i in range(batch.num_rows):
                b = an.opened(batch, i)
                s = block_sets(b)
                size, row = np.diff(s.first), rows_of(s)
                number, place = tx.runs(size - needed(size) + 1)
                shingle = ordered(s, counts)[s.first[number] + place]
                # The seeds of a set are its prefix shingles with the smallest hashes.
                by_hash = np.lexsort((tx.mixed(shingle), number))
                rank = np.empty(len(by_hash), np.int64)
                rank[by_hash] = tx.runs(np.bincount(number, minlength=1))[1] if len(number) else 0
                part = an.part_of(tx.mixed(shingle), parts)
                order = np.lexsort((number, part))
                own, at = np.unique(part[order], return_index=True)
                rows = []
                for lo, hi in zip(at, [*at[1:], len(order)], strict=True):
                    x = order[lo:hi]
                    short = shingle[x].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]
                    rows.append(an.packed(short, row[number[x]].astype(np.uint32), size[number[x]].astype(np.uint32), place[x].astype(np.uint32), (rank[x] < SEEDS).view(np.uint8)))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([b.block] * len(own), pa.int64()), pa.array(rows, pa.binary())], names=["part", "block", "postings"])

    return run


SHARED = "token long, node long, n int, place int, pivot long"


def _shared_lists(table: pa.Table) -> pa.Table:
    """Postings of the shingles that several nodes have, seeds with the first node of their list."""
    columns = []
    for block, data in zip(table.column("block").to_pylist(), table.column("postings").to_pylist(), strict=True):
        short, number, n, place, seed = an.unpacked(data, np.uint8, np.uint32, np.uint32, np.uint32, np.uint8)
        token = np.zeros((len(number), 8), np.uint8)
        token[:, :SET_BYTES] = short.reshape(-1, SET_BYTES)
        columns.append((token.view("<i8").ravel(), node_id(block, 0) + number.astype(np.int64), n.astype(np.int64), place.astype(np.int64), seed.astype(bool)))
    token, node, n, place, seed = (np.concatenate(x) for x in zip(*columns, strict=True))
    order = np.lexsort((node, token))
    token, node, n, place, seed = (x[order] for x in (token, node, n, place, seed))
    fresh = np.ones(len(token), bool)
    fresh[1:] = token[1:] != token[:-1]
    start = np.flatnonzero(fresh)
    count = np.diff(np.append(start, len(token)))
    first = np.repeat(start, count)
    shared = np.repeat(count > 1, count)
    close = 100 * np.minimum(n, n[first]) >= NEED * np.maximum(n, n[first])
    partner = shared & seed & close & (node != node[first])
    pivot = pa.array(node[first][shared], pa.int64(), mask=~partner[shared])
    return pa.table({"token": token[shared], "node": node[shared], "n": pa.array(n[shared], pa.int32()), "place": pa.array(place[shared], pa.int32()), "pivot": pivot})


def divide_skip(query: np.ndarray, members: list[np.ndarray]) -> np.ndarray:
    """Overlap of the query with every member that reaches the overlap it needs, else 0."""
    size = np.array([len(m) for m in members])
    need = overlap_needed(len(query), size)
    least = int(need.min())
    tokens = np.concatenate(members)
    order = np.argsort(tokens, kind="stable")
    who = np.repeat(np.arange(len(members)), size)[order]
    low, high = np.searchsorted(tokens[order], query), np.searchsorted(tokens[order], query, "right")
    length = high - low
    lists = np.argsort(length, kind="stable")
    longest = int(length.max(initial=0))
    aside = min(least - 1, int(least / (MU * np.log2(max(2, longest)) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    found = np.zeros(len(members), np.int64)
    for member in heapq.merge(*[who[low[i] : high[i]].tolist() for i in short.tolist() if length[i]]):
        found[member] += 1
    alive = np.flatnonzero((found > 0) & (found + aside >= need)) if least > aside else np.arange(len(members))
    for i in long.tolist():
        if length[i] and len(alive):
            at = low[i] + np.searchsorted(who[low[i] : high[i]], alive)
            found[alive] += (at < high[i]) & (who[np.minimum(at, len(who) - 1)] == alive)
    out = np.zeros(len(members), np.int64)
    out[alive] = found[alive]
    return np.where(out >= need, out, 0)


def _set_batches(taken):
    """Sets of the nodes that a search may ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                nodes = node_id(batch.column("block")[i].as_py(), 0) + np.arange(len(batch.column("doc_ids")[i]))
                asked = np.flatnonzero(holds(taken.value, nodes, FILTER))
                if not len(asked):
                    continue
                b = an.opened(batch, i)
                texts = [b.data[b.offsets[x] : b.offsets[x + 1]] for x in asked.tolist()]
                some = an.Block(b.block, asked.tolist(), np.cumsum([0, *map(len, texts)]), np.concatenate(texts))
                for _, data, offsets, base in an.slices_of(some):
                    doc, hashes = _slice_sets(data, offsets)
                    edges = np.searchsorted(doc, np.arange(len(offsets)))
                    short = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES])
                    sets = [short[lo:hi].tobytes() for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[asked[base : base + len(sets)]], pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    nodes = table.column("node").to_pylist()
    sets = {}
    for node, data in zip(nodes, table.column("shingles").to_pylist(), strict=True):
        own = np.zeros((len(data) // SET_BYTES, 8), np.uint8)
        own[:, :SET_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SET_BYTES)
        sets[node] = np.sort(own.view("<u8").ravel())
    query = key[0].as_py()
    members = [x for x in sets if x != query]
    overlap = divide_skip(sets[query], [sets[x] for x in members]) if members else np.zeros(0)
    hits = [x for x, n in zip(members, overlap.tolist(), strict=True) if n]
    return pa.table({"a": pa.array([query] * len(hits), pa.int64()), "b": pa.array(hits, pa.int64())})


def _print_batches(taken):
    """Prints of the nodes that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(holds(taken.value, batch.column("node").to_numpy(), FILTER)))

    return run


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose prints differ in no more bits than linked sets may differ in shingles."""
    for batch in batches:
        n, m = (batch.column(c).to_numpy() for c in ("query_n", "node_n"))
        most = n + m - 2 * overlap_needed(n, m)
        keep = np.zeros(batch.num_rows, bool)
        for i, (a, b) in enumerate(zip(batch.column("query_bits").to_pylist(), batch.column("node_bits").to_pylist(), strict=True)):
            size = min(len(a), len(b))
            differ = folded(np.frombuffer(a, np.uint8), size) ^ folded(np.frombuffer(b, np.uint8), size)
            keep[i] = np.bitwise_count(differ).sum() <= most[i]
        yield batch.select(["query", "node"]).filter(pa.array(keep))


def plausible(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (query, node) that may link by their ``prints`` (node, n, bits)."""
    nodes = pairs.select(F.explode(F.array("query", "node")).alias("key"))
    taken = prints.sparkSession.sparkContext.broadcast(bitmap(nodes, FILTER))
    asked = prints.mapInArrow(_print_batches(taken), "node long, n long, bits binary")
    side = lambda c: asked.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits"))
    met = side("node").join(side("query").join(pairs.hint("merge"), "query").hint("merge"), "node")
    return met.select("query", "query_n", "query_bits", "node", "node_n", "node_bits").mapInArrow(_may_link, "query long, node long")


def search(stored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (a, b) among distinct pairs (query, node): every query meets blocks of its members."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("query", "salt", "node")
    asked = salted.unionByName(salted.select("query", "salt", F.col("query").alias("node")).distinct())
    nodes = pairs.select(F.explode(F.array("query", "node")).alias("key"))
    taken = stored.sparkSession.sparkContext.broadcast(bitmap(nodes, FILTER))
    sets = stored.select("block", "offsets", "doc_ids", "data").mapInArrow(_set_batches(taken), "node long, shingles binary")
    # The same plan at every size: what is asked grows with the corpus, so it is not broadcast.
    met = sets.join(asked.hint("merge"), "node").select("query", "salt", "node", "shingles")
    return met.groupBy("query", "salt").applyInArrow(_search, "a long, b long")


def _with_blocks(pairs: DataFrame) -> DataFrame:
    """Pairs (query, node) with the number of blocks that the query's members are cut into."""
    sizes = pairs.groupBy("query").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    return pairs.join(sizes, "query")


def _pairs_of_lists(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows (i, j), j before i, inside each of some small lists."""
    group, rank = tx.runs(counts)
    which, back = tx.runs(rank)
    i = starts[group[which]] + rank[which]
    j = starts[group[which]] + back
    return i, j


def _lists_of(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal tokens."""
    fresh = np.ones(len(token), bool)
    fresh[1:] = token[1:] != token[:-1]
    start = np.flatnonzero(fresh)
    return start, np.diff(np.append(start, len(token)))


def candidates(turn: int, every: bool, need: int = NEED):
    """Pairs of a part's lists in different components that may reach the overlap they need.

    Unless ``every``, a list with more than ``CROSS`` pairs of different components stays open: the
    members outside its largest component meet the first 4 ** ``turn`` of that one and as many
    neighbours of their own. The order is by hash, so lists of the same nodes give the same pairs.
    """
    some = 4**turn

    def run(table: pa.Table) -> pa.Table:
        c = {x: table.column(x).to_numpy().astype(np.int64) for x in ("token", "node", "n", "place", "component")}
        order = np.lexsort((c["node"], c["component"], c["token"]))
        c = {k: v[order] for k, v in c.items()}
        # What follows a member's place must do for the smallest partner that its list can have.
        start, counts = _lists_of(c["token"])
        least = np.maximum(np.repeat(np.minimum.reduceat(c["n"], start), counts), needed(c["n"], need))
        keep = c["n"] - c["place"] >= overlap_needed(c["n"], least, need)
        c = {k: v[keep] for k, v in c.items()}
        start, counts = _lists_of(c["token"])
        several = c["component"][start] != c["component"][start + counts - 1]
        start, counts = start[several], counts[several]

        def may_link(i, j):
            best = np.minimum(c["n"][i] - c["place"][i], c["n"][j] - c["place"][j])
            return (c["component"][i] != c["component"][j]) & (best >= overlap_needed(c["n"][i], c["n"][j], need))

        found, still_open = [], []

        def compare(i, j):
            hit = may_link(i, j)
            found.append((c["node"][i[hit]], c["node"][j[hit]]))

        small = counts <= 64
        for k in range(0, int(small.sum()), 4096):
            compare(*_pairs_of_lists(start[small][k : k + 4096], counts[small][k : k + 4096]))
        for first, count in zip(start[~small].tolist(), counts[~small].tolist(), strict=True):
            rows = np.arange(first, first + count)
            component, sizes = np.unique(c["component"][rows], return_counts=True)
            if not every and (count * count - int((sizes**2).sum())) // 2 > CROSS:
                still_open.append(int(c["token"][first]))
                by_hash = rows[np.argsort(tx.mixed(c["node"][rows].astype(np.uint64)), kind="stable")]
                largest = c["component"][by_hash] == component[sizes.argmax()]
                others = by_hash[~largest]
                for pivot in by_hash[largest][:some].tolist():
                    compare(others, np.full(len(others), pivot))
                for back in range(1, min(some + 1, len(others))):
                    compare(others[back:], others[:-back])
                continue
            for i in rows[1:].tolist():
                compare(np.full(i - first, i), np.arange(first, i))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        opened = pa.array([None] * pairs.shape[1] + still_open, pa.int64())
        none = [None] * len(still_open)
        return pa.table({"query": pa.array(pairs[0].tolist() + none, pa.int64()), "node": pa.array(pairs[1].tolist() + none, pa.int64()), "token": opened})

    return run


def linked(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, key (of its text), n_shingles, component_id, component_key.

    A component's first document, which names it, is the one with the smallest (doc_id, key).
    """
    spark = documents.sparkSession
    stored = an.blocks(documents)
    columns = ["block", "offsets", "doc_ids", "keys", "data"]
    counted = written(stored.select(*columns).mapInArrow(_count_batches, COUNTED), "sketch", "zstd")
    sketch = spark.sparkContext.broadcast(sketched(counted.filter("chunk >= 0").select("chunk", "counts")))
    docs, prints = (counted.filter("chunk < 0").select(F.inline(c)) for c in ("docs", "prints"))

    parts = an.parts_for(stored)
    sent = stored.select(*columns).mapInArrow(_posting_batches(sketch, parts), "part long, block long, postings binary")
    lists = written(sent.groupBy("part").applyInArrow(_shared_lists, SHARED), "lists")
    # First round: every node meets the first node of the lists that it shares most of its seeds with.
    seeds = lists.filter("pivot IS NOT NULL").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("n"))
    first = seeds.groupBy("node").agg(F.max(F.struct("n", "pivot")).alias("x"))
    tested = written(first.select(F.least("node", "x.pivot").alias("query"), F.greatest("node", "x.pivot").alias("node")).distinct(), "pairs")
    pairs = written(_with_blocks(plausible(prints, tested)), "pairs")
    known = written(components(search(stored, pairs)), "components")
    lists, every, turn = lists.select("token", "node", "n", "place"), False, 0
    while True:
        named = lists.join(known.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        part = F.pmod(F.xxhash64("token"), F.lit(parts)).alias("part")
        found = written(named.select(part, *named.columns).groupBy("part").applyInArrow(candidates(turn, every), "query long, node long, token long"), "candidates")
        pairs = found.filter("query IS NOT NULL").select("query", "node").distinct().join(tested, ["query", "node"], "left_anti")
        fresh = written(pairs, "pairs")
        # A table of its own: its size is known when it is joined, and few tokens do not move all lists.
        opened = written(found.filter("token IS NOT NULL").select("token"), "open")
        new = None
        if not fresh.isEmpty():
            tested = tested.unionByName(fresh)
            pairs = written(_with_blocks(plausible(prints, fresh)), "pairs")
            new = written(search(stored, pairs), "links")
            known = written(extended(known, new), "components")
        if opened.isEmpty():
            break
        # Only open lists are looked at again; whole ones, once a round finds no link.
        lists, every = lists.join(opened, "token", "left_semi"), new is None or new.isEmpty()
        turn += 1
    named = docs.join(known, "node", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("_c"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("_first")
    out = named.join(named.filter("_c IS NOT NULL").groupBy("_c").agg(first), "_c", "left")
    alone = F.col("_c").isNull()
    return out.select(
        "doc_id", "key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("_first.doc_id")).alias("component_id"),
        F.when(alone, F.col("key")).otherwise(F.col("_first.key")).alias("component_key"),
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` with the first document of every component, all columns kept.

    Rows with the same id and text are one document: the one whose other columns come first stays.
    """
    kept = linked(documents).filter("doc_id <=> component_id AND key = component_key").select(F.struct("doc_id", "key").alias("_name")).distinct()
    return one_of_each_name(named(documents).join(kept, "_name", "left_semi"))


def op4(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    return linked(documents).select("doc_id", "n_shingles", "component_id")
