"""Suffix and substring deduplication against their brute-force versions."""

import random

import numpy as np
import pytest
from brute import op2, op10

from varstrip.llm import anchors, substring_dedup, suffix_dedup


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


SUFFIX = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
WORDS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


@pytest.mark.parametrize("part_bytes", [4 << 20, 20_000])
def test_suffix_dedup(frame, odd, monkeypatch, part_bytes):
    monkeypatch.setattr(anchors, "PART_BYTES", part_bytes)
    assert rows(suffix_dedup.op2(frame(odd)), SUFFIX) == sorted(op2(odd), key=str)


@pytest.mark.parametrize("part_bytes", [4 << 20, 20_000])
def test_substring_dedup(frame, odd, monkeypatch, part_bytes):
    monkeypatch.setattr(anchors, "PART_BYTES", part_bytes)
    assert rows(substring_dedup.op10(frame(odd)), WORDS) == sorted(op10(odd), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_low_entropy_texts(frame, seed):
    """Few letters and words: many windows, contexts and offsets agree by chance."""
    rng = random.Random(seed)
    docs = []
    for i in range(60):
        unit = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 60)))
        docs.append((i, (unit * rng.randrange(1, 30))[: rng.randrange(0, 700)]))
    assert rows(suffix_dedup.op2(frame(docs)), SUFFIX) == sorted(op2(docs), key=str)
    docs = [(i, " ".join(rng.choice("xyz") if rng.random() < 0.02 else "x" for _ in range(rng.randrange(0, 200)))) for i in range(60)]
    assert rows(substring_dedup.op10(frame(docs)), WORDS) == sorted(op10(docs), key=str)


def test_whole_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    listed = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert rows(suffix_dedup.op2(docs.repartition(4)), SUFFIX) == sorted(op2(listed), key=str)
    assert rows(substring_dedup.op10(docs.repartition(4)), WORDS) == sorted(op10(listed), key=str)


def test_null_and_repeated_ids(frame):
    text = " ".join(f"word{i}" for i in range(60))
    got = rows(suffix_dedup.op2(frame([(None, text), (None, text), (7, text), (7, None)])), SUFFIX)
    removed = sorted((r[0] is None, r[2]) for r in got)
    n = len(text)
    assert removed == sorted([(True, 0), (True, n), (False, n), (False, 0)])
    got = substring_dedup.op10(frame([(None, text), (None, text), (7, None)])).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(0, 0), (60, 60), (60, 60)]


def test_empty_table(frame):
    assert suffix_dedup.op2(frame([])).count() == 0
    assert substring_dedup.op10(frame([])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_loser_tree_order_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    items = [rng.integers(0, 3, (rng.integers(0, 40), 12)).astype(np.uint8) for _ in range(rng.integers(1, 9))]
    runs = []
    for rows_ in items:
        ordered = np.array(sorted(map(bytes, rows_)), dtype="S12")
        rows_ = np.frombuffer(b"".join(sorted(map(bytes, rows_))), np.uint8).reshape(-1, 12)
        assert len(ordered) == len(rows_)
        runs.append((rows_.tobytes(), anchors.common(rows_, 1).tolist()))
    tree = suffix_dedup.LoserTree(runs, 12)
    out = [(runs[r][0][i * 12 : (i + 1) * 12], shared) for r, i, shared in tree]
    texts = [t for t, _ in out]
    assert texts == sorted(bytes(x) for rows_ in items for x in rows_)
    for (a, _), (b, shared) in zip(out, out[1:], strict=False):
        assert shared == next((k for k in range(12) if a[k] != b[k]), 12)
