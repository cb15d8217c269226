"""Near-duplicate documents by min-max hashing: minimum and maximum under every permutation.

A document is its set of distinct two-word shingles; two link if their similarity is at least
``NEED`` percent. A permutation of the shingles is evaluated once and gives two values, the smallest
and the largest: each agrees between two sets with the probability of their similarity, and as the
two are negatively correlated, the share of agreeing values is an unbiased estimate of less variance
than that of as many independent minima. ``PERMUTATIONS`` evaluations give twice as many values.

* *Signatures.* One pass over the texts, in numpy, per batch: every distinct set of a batch is one
  stored row (digests, values, bands, documents). Equal sets are one node from the first row on.
* *Bands.* Four values each, two minima and two maxima of four different permutations, 32 bands: a
  pair at the threshold is missed by all of them with a probability of 5e-8.
* *Candidates.* Buckets are never expanded into pairs at first: every node is compared with the first
  node of the bucket series that it shares most with. From then on only nodes of different components
  meet: all such pairs of a bucket with few of them, the largest component's first node against the
  others for a bucket with many, round by round. Once no round finds a link, the nodes that are left
  in such buckets are many and near each other, but mostly below the threshold: of their pairs only
  those are made that share one of the prefix shingles, rare ones first, that any link must share
  (lengths and positions allowing). Buckets decide who is left, the estimate and the sets who links.
* *Estimate.* Pairs whose signatures agree in less than ``AGREE`` of the values go: at the threshold
  that is 5.6 standard deviations away (1e-8).
* *Confirmation.* What is left is compared on the full sets. They are made in a second pass, for one
  document of each node that shares a bucket: a bitmap of ``FILTER`` bits keeps most other texts out
  of the shuffle. Pairs are sorted by their first node in blocks of at most ``MEMBERS``, and the sets
  stream through; components are stars that never leave the cluster.

Every join is an equi-join; a hot bucket or pivot is one side with at most one row per key against
another that Spark may split. Sets are 48-bit hashes of the shingles, compared in full.

Defined results: a document without words has no shingles and is its own component; a text of one
word is one shingle; repeated rows and ids are linked through their texts; a NULL ``doc_id`` counts
as larger than any other, and gets a NULL component (and is kept) if its component has no other id;
texts of any length are used whole; other columns are ignored (``deduplicated`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varstrip.llm import jaccard_join as jj
from varstrip.llm import text as tx
from varstrip.llm.bitmaps import bitmap, holds
from varstrip.llm.components import components, extended
from varstrip.llm.rows import named, one_of_each_name
from varstrip.llm.store import written

SHINGLE, NEED = 2, 80
PERMUTATIONS = 64
BANDS = 32
AGREE = 77  # of 2 * PERMUTATIONS values
MEMBERS = 256
FEW = 256  # cross-component pairs of a bucket that are compared at once
SET_BYTES = 6
FILTER = 1 << 22
POSTINGS = 100_000  # prefix shingles that one task compares
_random = np.random.default_rng(13)
FACTORS = _random.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _random.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a slice."""
    w = tx.words(data, offsets, tx.SOLID, fold=True)
    n = np.diff(w.first)
    size = np.minimum(n, SHINGLE)
    row, rank = tx.runs(np.where(n > 0, n - size + 1, 0))
    start = w.first[row] + rank
    hashes = tx.range_hashes(tx.prefix_sums(w.hashes), start, start + size[row])
    edges = np.searchsorted(row, np.arange(len(offsets)))
    for i in range(len(n)):
        own = np.sort(hashes[edges[i] : edges[i + 1]])
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row per (not empty) set: its minima, then its maxima."""
    hashes = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((2 * PERMUTATIONS, len(sets)), np.uint64)
    for k in range(PERMUTATIONS):
        turned = hashes * FACTORS[k] + SHIFTS[k]
        out[k] = np.minimum.reduceat(turned, first)
        out[PERMUTATIONS + k] = np.maximum.reduceat(turned, first)
    return np.ascontiguousarray(out.T)


def bands(values: np.ndarray) -> np.ndarray:
    """Bucket numbers of every signature, one per band."""
    j = np.arange(BANDS)
    low = 2 * j
    picks = np.stack([low, low + 1, PERMUTATIONS + (low + 17) % PERMUTATIONS, PERMUTATIONS + (low + 18) % PERMUTATIONS])
    h = np.broadcast_to(tx.mixed(j.astype(np.uint64) + np.uint64(1)), (len(values), BANDS))
    for pick in picks:
        h = tx.mixed(h * tx.BASE + values[:, pick])
    return h


def short(own: np.ndarray) -> bytes:
    """A set as it is stored: the low bytes of its hashes, sorted."""
    low = np.unique(own & np.uint64((1 << 8 * SET_BYTES) - 1))
    return np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]).tobytes()


def restored(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SET_BYTES, 8), np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SET_BYTES)
    return out.view("<u8").ravel()


_DOC = pa.struct([("doc_id", pa.int64()), ("key", pa.int64())])
_SIGNED = pa.schema(
    [("node", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("n", pa.int32()), ("values", pa.binary()), ("buckets", pa.list_(pa.int64())), ("docs", pa.list_(_DOC))]
)
SIGNED = "node long, one long, two long, n int, values binary, buckets array<long>, docs array<struct<doc_id:long,key:long>>"


def _signed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per distinct set of a slice of documents, numbered by task; texts without words share one."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for part in tx.slices(texts):
            keys = tx.text_keys(texts.slice(part.rows.start, part.rows.stop - part.rows.start))
            found: dict[bytes, list] = {}
            sets = []
            for doc_id, key, own in zip(ids[part.rows], keys, shingle_sets(part.data, part.offsets), strict=True):
                docs = found.setdefault(own.tobytes(), [])
                if not docs:
                    sets.append(own)
                docs.append({"doc_id": doc_id, "key": key})
            full = [own for own in sets if len(own)]
            values = signatures(full) if full else np.zeros((0, 2 * PERMUTATIONS), np.uint64)
            buckets = iter(bands(values).view(np.int64).tolist())
            # The low byte of a mixed value is enough to see whether two agree.
            marks = iter(tx.mixed(values).astype(np.uint8))
            rows = []
            for own, docs in zip(sets, found.values(), strict=True):
                one, two = (int(np.bitwise_xor.reduce(tx.mixed(own + np.uint64(c))).astype(np.int64)) if len(own) else 0 for c in (1, 2))
                signed = (next(marks).tobytes(), next(buckets)) if len(own) else (None, None)
                rows.append((number, one, two, len(own), *signed, docs))
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SIGNED, strict=True)], schema=_SIGNED)


def signed(documents: DataFrame) -> DataFrame:
    """The stored signatures of ``documents`` (doc_id, text)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_signed_batches, SIGNED), "signed")


def full_sets(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored (node, shingles) of ``nodes`` (node, _name: doc_id and key of one of its documents)."""
    taken = documents.sparkSession.sparkContext.broadcast(bitmap(nodes.select("_name.key"), FILTER))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(holds(taken.value, batch.column("key").to_numpy(), FILTER)))
            for part in tx.slices(batch.column("text")):
                names = [batch.column(c).slice(part.rows.start, part.rows.stop - part.rows.start) for c in ("doc_id", "key")]
                sets = [short(own) for own in shingle_sets(part.data, part.offsets)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(sets, pa.binary())], names=["doc_id", "key", "shingles"])

    rows = named(documents).select(F.col("_name.doc_id"), F.col("_name.key"), F.col("_row.text").cast("string").alias("text"))
    rows = rows.mapInArrow(asked, "doc_id long, key long, shingles binary").select(F.struct("doc_id", "key").alias("_name"), "shingles")
    # Rows of the same id and text have one set: the join's placement serves the grouping too.
    sets = rows.join(nodes.hint("merge"), "_name").groupBy("_name").agg(F.first("node").alias("node"), F.first("shingles").alias("shingles"))
    return written(sets.select("node", "shingles"), "sets")


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in enough values."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS) for c in ("va", "vb"))
        near = pa.array((a == b).sum(axis=1) >= AGREE)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], names=["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among sorted rows: every run (a, salt) opens with the set of a itself."""
    own = np.zeros(0, np.uint64)
    for batch in batches:
        found = ([], [])
        for a, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "shingles")), strict=True):
            other = restored(data)
            if b is None:
                own = other
                continue
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            both = int((own[at] == other).sum())
            if 100 * both >= NEED * (len(own) + len(other) - both):
                found[0].append(a)
                found[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])


def confirmed(rows: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (a, b) among distinct pairs (a, b) of nodes, on their full ``sets``; ``rows`` have the signatures."""
    side = lambda x: rows.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("values").alias(f"v{x}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    both = both.filter("100 * least(na, nb) >= %d * greatest(na, nb)" % NEED).select("a", "b", "va", "vb")
    near = written(both.mapInArrow(_agreeing, "a long, b long"), "near")
    blocks = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    salted = near.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("salt"), "b")
    asked = salted.select("a", "salt", "b", F.col("b").alias("node"))
    asked = asked.unionByName(asked.select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("a").alias("node")).distinct())
    met = asked.join(sets.hint("merge"), "node").select("a", "salt", "b", "shingles")
    return met.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(_confirmed, "a long, b long")


def _pairs(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _open_buckets(lists: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lists`` with their components, and the buckets that have several: their first node of the
    largest one, and the number of pairs across components."""
    named = written(lists.join(known.hint("merge"), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")), "named")
    sizes = named.groupBy("bucket", "component").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("c"))
    opened = sizes.groupBy("bucket").agg(F.max(F.struct("c", "node", "component")).alias("top"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.count(F.lit(1)).alias("components"))
    opened = opened.filter("components > 1").select("bucket", F.col("top.node").alias("pivot"), F.col("top.component").alias("main"), ((F.col("n") * F.col("n") - F.col("squares")) / 2).alias("cross"))
    return named, written(opened, "open")


def _across(members: DataFrame) -> DataFrame:
    """All pairs of different components inside buckets, each once."""
    other = members.select("bucket", F.col("node").alias("b"), F.col("component").alias("_c"))
    both = members.withColumnRenamed("node", "a").join(other, "bucket").filter("a < b AND component <> _c")
    return both.select("a", "b").distinct()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sketch of the shingles of its sets."""
    counts = np.zeros(jj.SKETCH, np.int64)
    for batch in batches:
        tokens = restored(b"".join(batch.column("shingles").to_pylist()))
        counts += np.bincount((tokens % np.uint64(jj.SKETCH)).astype(np.int64), minlength=jj.SKETCH)
    if counts.any():
        yield pa.RecordBatch.from_arrays(jj.chunks_of(counts), names=["chunk", "counts"])


_PLACED = "token long, node long, n int, place int, component long"


def _placed(sketch):
    """Prefix shingles of sets: all that a link can have as its first common one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [restored(data) for data in batch.column("shingles").to_pylist()]
            if not sets:
                continue
            size = np.array([len(x) for x in sets])
            s = jj.Sets(np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(size)]), np.concatenate(sets))
            number, place = tx.runs(size - jj.needed(size, NEED) + 1)
            token = jj.ordered(s, sketch.value)[s.first[number] + place]
            node, component = (batch.column(c).to_numpy()[number] for c in ("node", "component"))
            columns = zip((token.view(np.int64), node, size[number], place, component), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=["token", "node", "n", "place", "component"])

    return run


def _by_prefix(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``members`` (node, component) of different components that may link."""
    own = written(members.join(sets.hint("merge"), "node"), "members")
    sketch = members.sparkSession.sparkContext.broadcast(jj.sketched(own.mapInArrow(_counted, "chunk int, counts binary")))
    placed = written(own.mapInArrow(_placed(sketch), _PLACED), "placed")
    parts = 1 + placed.count() // POSTINGS
    part = F.pmod(F.xxhash64("token"), F.lit(parts)).alias("part")
    found = placed.select(part, "*").groupBy("part").applyInArrow(jj.candidates(0, True, NEED), "query long, node long, token long")
    return found.select(F.col("query").alias("a"), F.col("node").alias("b")).distinct()


def _compared(reps: DataFrame, sets: DataFrame, pairs: DataFrame, known: DataFrame, tested: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """``known`` and ``tested`` after those of ``pairs`` that are new, and whether a link was found."""
    pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    if pairs.isEmpty():
        return known, tested, False
    new = written(confirmed(reps, sets, pairs), "links")
    found = not new.isEmpty()
    if found:
        known = written(extended(known, new), "components")
    return known, tested.unionByName(pairs), found


def linked_nodes(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, component) of all signed nodes that have a link."""
    ids = rows.filter("n > 0").groupBy("one", "two", "n").agg(F.min("node").alias("node")).select("node")
    reps = written(rows.select("node", "n", "values", "buckets", F.get("docs", F.lit(0)).alias("_name")).join(ids, "node", "left_semi"), "nodes")
    banded = reps.select("node", F.explode("buckets").alias("bucket"))
    firsts = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last")
    lists = written(banded.join(firsts.select("bucket", "pivot"), "bucket"), "lists")
    reps = written(reps.select("node", "n", "values", "_name").join(lists.select("node").distinct(), "node", "left_semi"), "candidates")
    sets = full_sets(documents, reps.select("node", "_name"))
    # First round: the first node of the buckets that a node shares most of its bands with.
    shared = lists.filter("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("c"))
    best = shared.groupBy("node").agg(F.max(F.struct("c", "pivot")).alias("x"))
    tested = written(best.select(F.col("x.pivot").alias("a"), F.col("node").alias("b")), "pairs")
    known = written(components(confirmed(reps, sets, tested)), "components")
    lists, narrow = lists.select("bucket", "node"), False
    while True:
        named, opened = _open_buckets(lists, known)
        many = opened.filter(F.col("cross") > FEW)
        pairs = _across(named.join(opened.filter(F.col("cross") <= FEW).select("bucket"), "bucket"))
        others = named.join(many.select("bucket", "pivot", "main"), "bucket").filter("component <> main")
        pairs = pairs.unionByName(others.select(*_pairs("node", "pivot"))).distinct()
        known, tested, found = _compared(reps, sets, pairs, known, tested)
        if many.isEmpty():
            return known
        if narrow and not found:
            break
        # Only buckets with many pairs are looked at again.
        lists, narrow = named.join(many.select("bucket"), "bucket", "left_semi").select("bucket", "node"), True
    # The last round found no link: all members of such buckets are compared, in whatever bucket they are.
    return _compared(reps, sets, _by_prefix(sets, named.select("node", "component").distinct()), known, tested)[0]


def linked(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, key (of its text), n_shingles, component_id, component_key.

    A component's first document, which names it, is the one with the smallest (doc_id, key).
    """
    rows = signed(documents)
    known = linked_nodes(documents, rows)
    first = lambda d, k: F.min(F.struct(F.col(d).isNull().alias("none"), F.col(d).alias("doc_id"), F.col(k).alias("key")))
    # Per set, then per component: a third of the rows in one component are one row per set by then.
    own = rows.select("one", "two", "n", "node", F.inline("docs")).filter("n > 0")
    sets = written(own.groupBy("one", "two", "n").agg(F.min("node").alias("node"), first("doc_id", "key").alias("_own")), "sets")
    sets = sets.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = sets.groupBy("component").agg(F.min("_own").alias("_first"))
    named = sets.join(least, "component").select("one", "two", "n", "_first")
    out = rows.select("one", "two", "n", "docs").join(named, ["one", "two", "n"], "left").select("n", "_first", F.inline("docs"))
    alone = F.col("_first").isNull()
    return out.select(
        "doc_id", "key", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("_first.doc_id")).alias("component_id"),
        F.when(alone, F.col("key")).otherwise(F.col("_first.key")).alias("component_key"),
    )


def deduplicated(documents: DataFrame) -> DataFrame:
    """``documents`` with the first document of every component, all columns kept.

    Rows with the same id and text are one document: the one whose other columns come first stays.
    """
    kept = linked(documents).filter("doc_id <=> component_id AND key = component_key").select(F.struct("doc_id", "key").alias("_name")).distinct()
    return one_of_each_name(named(documents).join(kept, "_name", "left_semi"))


def op13(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    return linked(documents).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
