"""Quality rules, PII and URL filters against their brute-force versions."""

import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
import xxhash
from brute import op5, op8, solid
from pyspark.sql import functions as F

from varstrip.llm import pii, quality_rules, url_filter


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, 1)], "doc_id long, quality int").selectExpr("*", "0 AS toxic", "'x' AS text")


def test_base_statistics(frame, odd, labels):
    assert rows(quality_rules.op8(frame(odd), labels), BASE) == sorted(op8(odd), key=str)


def word_hash(word):
    return xxhash.xxh64(word.lower().encode(), seed=42).intdigest()


def buckets(text):
    """The buckets of a text's words, of its runs of punctuation, and of pairs of these."""
    h = [word_hash(w) for w in solid(text)]
    r = [word_hash(x) for x in re.findall(r"[!-/:-@\[-`{-~]+", text or "")]
    n, m = quality_rules.BUCKETS, quality_rules.MARKS
    return [x >> 24 & n - 1 for x in h], [n + (x & m - 1) for x in r] + [n + m + ((a ^ b >> 20) & m - 1) for a, b in zip(r, r[1:])]


def test_scores(frame, odd, labels):
    """The ratio of the two multinomials, by hand."""
    rng = random.Random(5)
    docs = [(d, t) for d, t in odd if (t or "").isascii()]  # one script
    docs += [(100 + i, " ".join(rng.choice(["Alpha", "beta,", "|", "gamma", "D-1"]) for _ in range(60))) for i in range(20)]
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    weight = {}
    for kind in (0, 1):  # each has its own rate
        raw, target = Counter(), Counter()
        for doc_id, text in docs:
            raw.update(buckets(text)[kind])
            target.update(buckets(text)[kind] if doc_id in trusted else [])
        n, m, s = sum(raw.values()), sum(target.values()), quality_rules.SUPPORT
        for g in raw:
            ratio = math.log((target[g] + s) / (round(raw[g] * m / n * 1e6) / 1e6 + s))
            weight[g] = round(max(-quality_rules.LIMIT, min(quality_rules.LIMIT, ratio)) * quality_rules.UNIT)
    got = {r.doc_id: r for r in quality_rules.op8(frame(docs), labels).collect()}
    for doc_id, text in docs:
        gs = sum(buckets(text), [])
        want = sum(weight[g] for g in gs) / quality_rules.UNIT / max(1, len(solid(text)))
        assert got[doc_id].score == pytest.approx(want, abs=1e-9)
        assert got[doc_id].kept == (not got[doc_id].base_failed and got[doc_id].score >= quality_rules.THRESHOLD)
    assert len({r.score for r in got.values()}) > 10


def test_verdicts_on_held_out_labels(spark, small):
    big = small.replace("0.001", "0.01")
    docs, given = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    fitted = given.filter("doc_id % 2 = 0")
    out = quality_rules.op8(docs, fitted).join(given.filter("doc_id % 2 = 1"), "doc_id").filter("NOT base_failed")
    good, bad = out.filter("quality = 1"), out.filter("quality = 0")
    assert good.filter("NOT kept").count() == 0
    assert bad.filter("kept").count() <= 0.1 * bad.count()


def test_words_and_scripts(spark):
    """Spam in plain letters goes, although its shapes are ordinary; a script the target lacks stays."""
    rng = random.Random(8)
    letters = lambda alphabet, n: ["".join(rng.choice(alphabet) for _ in range(rng.randint(3, 9))) for _ in range(n)]
    latin, cyrillic, spam = letters("abcdefghijklmnopqrstuvwxyz", 300), letters("абвгдежзиклмнопрстуф", 300), letters("abcdefghijklmnopqrstuvwxyz", 60)
    text = lambda words: " ".join(rng.choice(words) for _ in range(200))
    docs = [(i, text(latin)) for i in range(80)] + [(100 + i, text(spam)) for i in range(20)] + [(200 + i, text(cyrillic)) for i in range(20)]
    got = quality_rules.op8(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")).collect()
    assert not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if r.kept} == {d for d, _ in docs if not 100 <= d < 200}
    assert all(abs(r.score) <= 3 * quality_rules.LIMIT for r in got)
    assert len(got) == len(docs)


def test_weights_are_bounded(spark):
    """A bucket without trusted rows weighs the same however large the target is; a script that the target lacks weighs nothing."""
    for size in (10**4, 10**9):
        counts = spark.createDataFrame([(0, 1, 2 * size, size), (0, 2, size, 0), (7, 3, size, 0)], "script int, bucket int, raw long, target long")
        weights = {r.bucket: r.weight for r in quality_rules.weights(counts).collect()}
        assert weights[2] == -quality_rules.LIMIT * quality_rules.UNIT and weights[3] == 0 < weights[1]


def test_filtered_keeps_columns(frame, odd, labels):
    docs = frame(odd)
    out = quality_rules.filtered(docs, labels)
    assert out.columns == docs.columns
    want = quality_rules.op8(docs, labels).filter("kept").select("doc_id")
    assert rows(out, ["doc_id"]) == rows(want, ["doc_id"])


def test_quality_of_nothing(frame, labels):
    assert quality_rules.op8(frame([]), labels).count() == 0
    assert rows(quality_rules.op8(frame([(None, None)]), labels.limit(0)), [*BASE, "kept", "score"]) == [(None, 0, 0, 0, 0, 0, True, False, 0.0)]


PII_BASE = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]


def test_entities(frame, odd):
    rng = random.Random(3)
    made = [(200 + i, "".join(rng.choice("0123456789.+-@ ()aZé\n") for _ in range(300))) for i in range(150)]
    made += [(500 + i, "".join(rng.choice("014-  ") for _ in range(120)) + "\na@b.c_d@e.f..g 4242424242424242 +49 (0) 30 123456 00010.1.2.3") for i in range(40)]
    assert rows(pii.op5(frame(odd + made)), PII_BASE) == sorted(op5(odd + made), key=str)


def test_long_runs_do_not_blow_up(frame):
    docs = [(1, "a" * 60_000 + "@" + "b." * 30_000), (2, "1." * 30_000), (3, "1" * 60_000), (4, "+1" * 20_000), (5, "1.1.1.1 " * 5_000)]
    assert rows(pii.op5(frame(docs)), PII_BASE) == sorted(op5(docs), key=str)


def test_disclosing_terms(frame):
    """A codename beside one address on unlike pages is disclosed; page copies are no evidence."""
    rng = random.Random(1)
    filler = ["é", *[f"word{i}" for i in range(40)]]
    prose = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    docs = [(i, prose(200)) for i in range(40)]
    docs += [(100 + i, f"{prose(30)} é bluefalcon {rng.choice(filler)} bob@corp.example {prose(30)}") for i in range(6)]
    copied = f"{prose(30)} redherring {prose(2)} eve@corp.example {prose(30)}"
    docs += [(200 + i, copied) for i in range(6)]
    got = {r.doc_id: r.spans for r in pii.op5(frame(docs)).collect()}
    for doc_id, text in docs:
        spans = [s for s in got[doc_id].split(",") if s]
        found = {(s.split(":")[0], text[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in spans}
        if doc_id < 100:
            assert not found
        elif doc_id < 200:
            assert found == {("email", "bob@corp.example"), ("removed", "bluefalcon")}
        else:
            assert found == {("email", "eve@corp.example")}


def test_constant_phrase_discloses(frame):
    """The same words beside an address on otherwise different pages are evidence."""
    rng = random.Random(4)
    prose = lambda n: " ".join(f"word{rng.randrange(40)}" for _ in range(n))
    docs = [(i, prose(200)) for i in range(40)]
    docs += [(100 + i, f"{prose(30)} contact bluefalcon jane@corp.example redkite {prose(30)}") for i in range(6)]
    for doc_id, spans in ((r.doc_id, r.spans) for r in pii.op5(frame(docs)).collect()):
        text = docs[doc_id - 60 if doc_id >= 100 else doc_id][1]
        removed = {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in spans.split(",") if s) if k == "removed"}
        assert removed == ({"contact", "bluefalcon", "redkite"} if doc_id >= 100 else set())


def test_pii_of_nothing(frame):
    assert pii.op5(frame([])).count() == 0
    assert len(pii.op5(frame([(None, None), (None, None), (3, "x 1.2.3.4")])).collect()) == 3


def test_url_filter_matches_sql(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(1, None), (None, "http://a.b.example.com/x"), (2, "nonsense"), (3, "HTTP://u:p@Sub.Example.COM.:80/"), (3, "http://" + "a." * 300 + "com"), (4, "http://localhost/")], "page_id long, url string")
    pages = pages.unionByName(odd)
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}).convert_dtypes())
    got = url_filter.op7(pages).toPandas()
    want = con.execute(url_filter.OP7_SQL).df()
    key = lambda df: sorted(tuple("" if pd.isna(x) else str(x)[:10] if "-" in str(x)[:5] else str(x).removesuffix(".0") for x in r) for r in df[sorted(got.columns)].astype(object).itertuples(index=False))
    assert key(got) == key(want)
    assert got.blocked.any() and (got.action == "allow").any()


def test_entries_active_at_fetch_time(spark):
    day = lambda d: F.to_date(d)
    events = spark.createDataFrame([("example.com", "2024-02-01", "block"), ("ok.example.com", "2024-02-10", "allow"), ("example.com", "2024-03-05", "none"), ("example.com", "2024-04-01", "allow"), ("example.com", "2024-04-01", "block"), (None, "2024-01-01", "block")], "domain string, listed string, action string").withColumn("listed", day("listed"))
    asked = [(1, "2024-01-31", False), (2, "2024-02-01", True), (3, "2024-03-04", True), (4, "2024-03-05", False), (5, "2024-04-01", True), (6, None, False), (7, "2026-09-30", True)]
    captures = spark.createDataFrame([(i, "http://www.example.com/", d) for i, d, _ in asked] + [(9, "http://a.ok.example.com", "2024-02-11")], "page_id long, url string, fetched string").withColumn("fetched", day("fetched"))
    got = {r.page_id: (r.blocked, r.n_active) for r in url_filter.judged(captures, events).collect()}
    assert {i: got[i][0] for i, *_ in asked} == {i: b for i, _, b in asked}
    assert got[9] == (False, 2)
