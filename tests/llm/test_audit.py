"""The filter audit against a walk through every order, and its Shapley values against their definition."""

import math
from fractions import Fraction
from itertools import permutations

from brute import op11

from varstrip.llm import filter_audit

COLUMNS = ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(spark, docs, labels):
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    docs = docs.selectExpr("*", "1 AS mask", "2 AS part", "3 AS digest", "4 AS quality", "5 AS step", "6 AS _text")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS part", "1 AS mask")
    return sorted(tuple(r) for r in filter_audit.op11(docs, labels).select(*COLUMNS).collect())


def test_normal_equations_give_the_mean_over_all_orders():
    for n in (2, 3, 5):
        v = [Fraction(bin(s * 2654435761 % 2**31).count("1") * (s > 0)) for s in range(1 << n)]
        for i, row in enumerate(filter_audit.shapley_weights(n)):
            mean = Fraction(0)
            for order in permutations(range(n)):
                before = sum(1 << p for p in order[: order.index(i)])
                mean += v[before | 1 << i] - v[before]
            assert sum(w * x for w, x in zip(row, v, strict=True)) == mean / math.factorial(n)


def test_whole_table(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = audited(spark, docs, labels)
    assert got == sorted(op11(docs, labels))
    assert len({r[0] for r in got}) * 600 == len(got)


def test_odd_rows(spark, odd):
    langs = [None, "", "en", "日本", "en"]
    docs = [(d, t, langs[d % 5]) for d, t in odd]
    # Ties, copies under a smaller id in another part, NULL ids, repeated rows, texts of one filter each.
    docs += [(1000, odd[5][1], "fr"), (-3, odd[6][1], "de"), (None, odd[5][1], "en"), (None, odd[5][1], "en"), (7, odd[7][1], "en"), (7, odd[7][1], "de")]
    docs += [(2000, " ".join(f"w{i}" for i in range(300)), "solo"), (2001, " ".join(["a"] * 300), "solo"), (2002, "$ " + " ".join(f"v{i}" for i in range(300)), "solo"), (2003, "A" * 3 + "b" * 97, "solo"), (2004, "A" * 4 + "b" * 96, "solo")]
    labels = [(5, 1, 0), (5, 0, 1), (6, 1, None), (None, 1, 1), (7, 1, 1), (2001, None, 1), (99999, 1, 1)]
    assert audited(spark, docs, labels) == sorted(op11(docs, labels))


def test_empty_tables(spark):
    assert audited(spark, [], []) == []
    one = audited(spark, [(1, None, None)], [])
    assert len(one) == 600 and {r[0] for r in one} == {""} and sum(r[5] for r in one) == 120
