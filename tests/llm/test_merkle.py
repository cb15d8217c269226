"""Manifest and climb against a plain Merkle tree."""

import pytest
from brute import op12, sha

from varstrip.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def proved(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs = docs.selectExpr("*", "1 AS tree", "2 AS place", "3 AS n", "4 AS block", "5 AS leaf", "6 AS parent", "7 AS slot", "8 AS digest")
    return sorted((tuple(r) for r in merkle.op12(docs).collect()), key=key)


def test_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select(*merkle.FIELDS).collect()]
    got = proved(spark, rows)
    assert got == sorted(op12(rows), key=key)
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_hot_source_of_several_levels_and_many_small_ones(spark):
    # 5,000 leaves of one source are four levels and twenty blocks; sizes around the powers of 16.
    rows = [(i, "hot", "en", i % 7, f"Text {i}") for i in range(5000)]
    rows += [(i, f"s{n}", None, None, "A b") for n in (1, 2, 15, 16, 17, 255, 256, 257) for i in range(n)]
    rows += [(i, f"one{i}", "x", 1, None) for i in range(300)]
    assert proved(spark, rows) == sorted(op12(rows), key=key)


@pytest.mark.parametrize("n", [0, 1, 2, 17])
def test_one_source(spark, n):
    rows = [(i, "s", "en", 3, "ABC") for i in range(n)]
    got = proved(spark, rows)
    assert got == sorted(op12(rows), key=key)
    if n == 1:
        assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")


def test_odd_rows(spark, odd):
    sources = [None, "", "é", "z", "Z", "s"]
    rows = [(d, sources[d % 6], [None, "en"][d % 2], None if t is None else len(t), t) for d, t in odd]
    # NULL ids and sources, repeated rows, ties of ids with other columns, everything NULL.
    rows += [(None, None, None, None, None)] * 2 + [rows[5], rows[5], (5, rows[5][1], "de", 1, "Other"), (None, "z", "en", 1, "ABC"), (-7, "z", "en", 1, "ABC")]
    assert proved(spark, rows) == sorted(op12(rows), key=key)


def test_setting_is_restored(spark):
    before = spark.conf.get(merkle.ROW_LIMIT)
    proved(spark, [(1, "a", "b", 2, "C")])
    assert spark.conf.get(merkle.ROW_LIMIT) == before
