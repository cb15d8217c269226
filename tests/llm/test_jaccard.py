"""The Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from brute import op4

from varstrip.llm import jaccard_join
from varstrip.llm.components import components, extended

COLUMNS = ["doc_id", "n_shingles", "component_id"]


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def near_copies(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    docs = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 8, 30, 120, 400]))]
        for _ in range(rng.randrange(1, 12)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 30, len(base) // 15, len(base) // 8])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(300)}"
            docs.append((len(docs), " ".join(words)))
    return docs


def test_odd_documents(frame, odd):
    assert rows(jaccard_join.op4(frame(odd))) == sorted(op4(odd), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_near_copies(frame, seed):
    docs = near_copies(seed)
    assert rows(jaccard_join.op4(frame(docs))) == sorted(op4(docs), key=str)


def test_chains_that_no_pivot_sees(frame):
    """Each text is near the next one only, so components grow over several rounds."""
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(55)]
    want = sorted(op4(docs), key=str)
    assert len({c for *_, c in want}) < 5
    assert rows(jaccard_join.op4(frame(docs))) == want


def test_searches_move_sets_only(spark, frame):
    """The texts stay where they are stored: no join or exchange of a search holds them."""
    docs = [(i, f"one two three four five six {'seven' if i % 2 else 'eight'}") for i in range(4)]
    stored = jaccard_join.an.blocks(frame(docs).coalesce(1))
    pairs = spark.createDataFrame([(0, 1, 1)], "query long, node long, blocks int")
    links = jaccard_join.search(stored, pairs)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan
    assert not re.search(r"Join .*block#", plan)
    assert links.count() == 0


def test_rounds_of_a_group_of_near_copies(frame, monkeypatch):
    """Copies of one text, most of them linked with each other but not all with the pivot."""
    monkeypatch.setattr(jaccard_join, "CROSS", 64)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(200):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(200)] = f"e{rng.randrange(4)}"
        docs.append((i, " ".join(words)))
    assert rows(jaccard_join.op4(frame(docs))) == sorted(op4(docs), key=str)


@pytest.mark.parametrize("every", [False, True])
def test_candidates_of_a_list(every):
    """All pairs that may link, or a few for every member outside the largest component."""
    n = 200
    table = pa.table({"token": [5] * n, "node": range(n), "n": [100] * n, "place": [0] * 150 + [20] * 50, "component": [0] * 100 + [*range(100, n)]})
    columns = {k: pa.array(v, pa.int64()) for k, v in table.to_pydict().items()}
    got = jaccard_join.candidates(0, every)(pa.table(columns)).to_pylist()
    pairs = {(r["query"], r["node"]) for r in got if r["token"] is None}
    # Nothing after place 14 of 100 shingles can make up for what no partner shares before.
    assert all(a < b < 150 for a, b in pairs)
    assert len(pairs) == (100 * 50 + 50 * 49 // 2 if every else 50 + 49)
    assert [r["token"] for r in got if r["token"] is not None] == ([] if every else [5])


def test_whole_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    listed = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert rows(jaccard_join.op4(docs.repartition(4))) == sorted(op4(listed), key=str)


def test_nothing_and_null_ids(frame):
    assert jaccard_join.op4(frame([])).count() == 0
    got = rows(jaccard_join.op4(frame([(None, "a b c d e f"), (4, "A B C D E F"), (9, None), (None, ""), (4, "A B C D E F")])))
    assert got == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (9, 0, 9), (None, 0, None)], key=str)


@pytest.mark.parametrize("seed", range(20))
def test_divide_skip(seed):
    rng = np.random.default_rng(seed)
    query = np.unique(rng.integers(0, 60, 40)).astype(np.uint64)
    members = [np.unique(np.where(rng.random(len(query)) < rng.random() / 3, rng.integers(100, 200, len(query)), query)).astype(np.uint64) for _ in range(30)]
    got = jaccard_join.divide_skip(query, members)
    for m, n in zip(members, got, strict=True):
        both = len(np.intersect1d(query, m))
        assert n == (both if 4 * both >= 3 * (len(query) + len(m) - both) else 0)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(30)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {(x, root(x)) for a, b in pairs if a != b for x in (a, b)}
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == want
    half = components(spark.createDataFrame(pairs[:70], "a long, b long"))
    both = extended(half, spark.createDataFrame(pairs[70:], "a long, b long").filter("a <> b"))
    groups = {}
    for node, component in both.collect():
        groups.setdefault(component, set()).add(node)
    expected = {}
    for node, component in want:
        expected.setdefault(component, set()).add(node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("seed", range(5))
def test_prints_drop_no_link(spark, seed):
    """Pairs at and above the threshold pass, of any two lengths; most pairs far below are dropped."""
    rng = np.random.default_rng(seed)
    sets = []
    for size in (1, 5, 63, 64, 65, 300, 800):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for change in (0, 0.05, 0.14, 0.25, 0.6, 1):
            fresh = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base[int(change * size) :], fresh[: int(change * size)]])))
            sets.append(np.unique(np.concatenate([base, fresh[: int(change * size / 3)]])))
    prints = spark.createDataFrame([(i, len(x), bytearray(jaccard_join.parity_print(x))) for i, x in enumerate(sets)], "node long, n long, bits binary")
    every = [(i, j) for j in range(len(sets)) for i in range(j)]
    kept = {tuple(r) for r in jaccard_join.plausible(prints, spark.createDataFrame(every, "query long, node long")).collect()}
    both = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i, j in every}
    union = {(i, j): len(sets[i]) + len(sets[j]) - both[i, j] for i, j in every}
    linked = {p for p in every if 4 * both[p] >= 3 * union[p]}
    assert len(linked) > 30
    assert linked <= kept
    far = [p for p in every if 2 * both[p] <= union[p] and min(len(sets[p[0]]), len(sets[p[1]])) >= 300]
    assert len(far) > 100
    assert sum(p in kept for p in far) <= len(far) // 20


def test_searches_make_asked_sets_only(frame, monkeypatch):
    """A block with one document asked for makes one set."""
    stored = jaccard_join.an.blocks(frame([(i, f"a{i} b c d e f g h") for i in range(50)]).coalesce(1))
    batch = stored.select("block", "offsets", "doc_ids", "data").toArrow().to_batches()[0]
    taken = np.zeros(jaccard_join.FILTER // 8 + 1, np.uint8)
    taken[37 // 8] |= 1 << (37 % 8)

    class Taken:
        value = taken

    made, inner = [], jaccard_join._slice_sets
    monkeypatch.setattr(jaccard_join, "_slice_sets", lambda data, offsets: made.append(len(offsets) - 1) or inner(data, offsets))
    out = [r for b in jaccard_join._set_batches(Taken)([batch]) for r in b.to_pylist()]
    assert made == [1]
    assert [(r["node"], len(r["shingles"])) for r in out] == [(37, 4 * jaccard_join.SET_BYTES)]
