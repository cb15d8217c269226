"""The corpus pipeline against its stages' brute-force versions."""

import corpus_pipeline
from brute import op1, op4, op6

from varstrip.llm import quality_rules, secret_scan


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    # The quality verdict has a test of its own.
    good = {r.doc_id for r in quality_rules.op8(docs, labels).collect() if r.kept}
    left = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    left = [(d, t) for (d, t), (_, _, c) in zip(left, op4(left), strict=True) if d == c]
    leaks = {r[0] for r in op1(left, items) if r[-1]}
    left = [(d, secret_scan.masked(t.encode()).decode()) for d, t in left if d not in leaks]
    want = op6(left, corpus_pipeline.TOKENIZER)
    got = [tuple(r) for r in corpus_pipeline.run(spark, small).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(want)
    assert 0 < len(want) < len(good) < docs.count()


def test_stages_keep_columns_and_odd_rows(spark, small, odd):
    rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in odd]
    rows += [(None, None, None, None, None), rows[5], rows[5], (None, rows[5][1], None, None, 1), (None, rows[5][1], None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.schema.names == docs.schema.names, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert docs.count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()


def test_stages_keep_columns_of_clashing_names(spark, small, odd):
    """Columns named like the operators' own come back as they went in."""
    own = ["_own", "_id", "_key", "_name", "_row", "_doc", "key", "node", "row", "block", "shard", "n_words", "kept", "_words", "component_id", "contaminated", "spans", "score"]
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in own])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.schema.names == docs.schema.names, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in own), name
        docs = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()


def test_repeated_rows_become_the_first_one(spark, small):
    """Of rows equal in id and text the one whose other columns come first stays, wherever it lies."""
    text = " ".join(f"w{i % 7}x{i}" for i in range(80))
    rows = [(1, text, "z"), (1, text, "a"), (1, text, None), (2, text, "0")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)
        assert [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, small).collect()] == [(1, text, None)]


def test_stages_take_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0
