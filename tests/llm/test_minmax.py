"""Min-max hashing against all pairs."""

import random

import numpy as np
from brute import op13

from varstrip.llm import minmax_dedup


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.selectExpr("*", "1 AS node", "2 AS one", "3 AS n", "4 AS values", "5 AS docs", "6 AS key", "7 AS component")
    return sorted(tuple(r) for r in minmax_dedup.op13(docs).collect())


def test_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = found(spark, rows)
    assert got == sorted(op13(rows))
    assert any(not r[-1] for r in got)


def test_odd_rows(spark, odd):
    assert found(spark, odd) == sorted(op13(odd))


def test_chains_thresholds_and_groups_of_copies(spark, monkeypatch):
    """Copies drift away from their first text by a word at a time; many share a band without a link."""
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(500)]
    rows, k = [], 0
    for _ in range(6):
        words = [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(25):
            words = list(words)
            words[rng.randrange(60)] = f"new{k}"
            rows.append((k, " ".join(words)))
            k += 1
    base = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(120):  # pairs of a similarity around the threshold
        words = list(base)
        for at in rng.sample(range(60), rng.randrange(1, 7)):
            words[at] = f"new{rng.randrange(10_000)}"
        rows.append((k, " ".join(words)))
        k += 1
    for n in range(1, 14):  # sets of a few shingles
        rows += [(k, " ".join(vocabulary[:n])), (k + 1, " ".join(vocabulary[: n + 1]) + " x")]
        k += 2
    want = sorted(op13(rows))
    assert found(spark, rows) == want
    # The same when buckets of a few pairs already count as large.
    monkeypatch.setattr(minmax_dedup, "FEW", 2)
    assert found(spark, rows) == want


def test_copies_below_the_threshold_are_not_paired(spark, monkeypatch):
    """Texts that share bands with each other but mostly no link: their pairs stay few, their links whole."""
    written, pairs = minmax_dedup.written, []

    def counted(df, name, *how):
        out = written(df, name, *how)
        if name in ("pairs", "near"):
            pairs.append(out.count())
        return out

    monkeypatch.setattr(minmax_dedup, "written", counted)
    rng = random.Random(11)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for k in range(400):
        words = list(base)
        for at in rng.sample(range(150), 12):
            words[at] = f"new{k}x{at}"
        rows.append((k, " ".join(words)))
        if k % 20 == 0:
            words[rng.randrange(150)] = "other"
            rows.append((1000 + k, " ".join(words)))
    assert found(spark, rows) == sorted(op13(rows))
    # A pivot of each of the 32 bands at most, not all pairs.
    assert max(pairs) < 40 * len(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "some words that stand here more than once today"
    rows = [(4, text), (4, text), (None, text), (2, text.upper()), (None, None), (9, " "), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minmax_dedup.op13(docs).collect()}
    assert got == {(4, 8, 2, False), (None, 8, 2, False), (2, 8, 2, True), (None, 0, None, True), (9, 0, 9, True), (None, 1, None, True)}
    assert minmax_dedup.op13(docs).count() == len(rows)
    assert minmax_dedup.op13(docs.limit(0)).count() == 0
    kept = docs.selectExpr("text", "doc_id", "'x' AS _name", "doc_id AS _row", "1 AS component_id")
    out = minmax_dedup.deduplicated(kept)
    assert out.columns == kept.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in out.collect()) == [(False, 0, ""), (False, 0, "alone here"), (True, 2, text.upper()), (True, 9, " ")]


def test_estimate_is_unbiased_and_better_than_independent_minima():
    """Share of agreeing values over many pairs of sets of a known similarity."""
    rng = np.random.default_rng(3)
    errors, halves = [], []
    for _ in range(300):
        own = rng.integers(0, 2**63, 40, dtype=np.uint64)
        a, b = np.unique(own[:34]), np.unique(own[6:])
        same = np.equal(*minmax_dedup.signatures([a, b]))
        errors.append(same.mean() - 28 / 40)
        halves.append(same[: minmax_dedup.PERMUTATIONS].mean() - 28 / 40)
    assert abs(np.mean(errors)) < 0.01
    # Half the variance of the minima alone, and a little less as minimum and maximum exclude each other.
    assert np.var(errors) < 0.5 * np.var(halves)
