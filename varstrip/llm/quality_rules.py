"""Quality rules: text statistics and an n-gram log-likelihood ratio, all in built-in functions.

Multinomials over hashed n-grams are counted for every document (raw corpus) and for the trusted
target. The n-grams are whole lower-cased words as they stand, runs of punctuation, and pairs of
neighbouring runs. Words have ``BUCKETS`` buckets, runs and their pairs ``MARKS`` each. With e the
count that the target would have at the raw rate, a bucket weighs log((count + SUPPORT) / (e +
SUPPORT)), at most ``LIMIT`` either way: what the target lacks counts only as far as it was to be
expected. A word's rate is that of its own script, so a script that the target lacks is no
evidence. Weights are whole numbers, ``UNIT`` to one.

A document's score is the weight of its n-grams over the number of its words; it is kept if the
score reaches a fixed threshold and no base rule fails. Sums are whole, so a score does not depend on any
order.

The target is fitted on labelled rows, at most ``TRUSTED`` of them (the lowest ids, a parameter);
raw counts and scores cover all documents. The number of buckets is the same at every size; what
goes to the driver and into the plan is one number a bucket. One pass over the texts counts, one
scores; n-grams are pre-aggregated in the task that reads them, so only one row per bucket, script
and task is shuffled, however long or frequent anything is.

Defined results: a NULL text has no words; a document without words scores 0; without trusted rows
every score is 0; repeated rows, repeated and NULL ids are rows like any other; other columns are
ignored (``filtered`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrip.llm.store import written

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
# Punctuation: the ASCII characters that are neither letters, digits, blanks nor controls.
RUN = r"([!-/:-@\[-`{-~]+)"
BUCKETS, MARKS = 1 << 17, 1 << 14
TRUSTED = 20_000
SUPPORT, LIMIT = 5.0, 3.0
UNIT = 40  # so that a weight fits one signed byte
THRESHOLD = -0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def word_array(text: Column) -> Column:
    """Words between blanks, in order; NULL gives none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN, -1))


def runs_of(text: Column) -> Column:
    """Runs of punctuation, in order; NULL gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN))


def following(items: str) -> Column:
    """An array without its first item."""
    return F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(1)))


def word_hash(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def word_bucket(h: Column) -> Column:
    """Bucket of a word by its hash: 0 to BUCKETS - 1."""
    return F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def run_bucket(h: Column) -> Column:
    """Bucket of a run by its hash: the next MARKS."""
    return (h.bitwiseAND(F.lit(MARKS - 1)) + BUCKETS).cast("int")


def pair_bucket(first: Column, second: Column) -> Column:
    """Bucket of two neighbouring runs by their hashes: the last MARKS."""
    return (first.bitwiseXOR(F.shiftrightunsigned(second, 20)).bitwiseAND(F.lit(MARKS - 1)) + BUCKETS + MARKS).cast("int")


def script(word: Column) -> Column:
    """Number of a word's script by the block of its middle code point; Latin and all ASCII are 0."""
    point = F.ascii(F.substring(word, ((F.length(word) + 1) / 2).cast("int"), F.lit(1)))
    block = F.when(point < 0x370, 0).when(point < 0x3400, F.shiftright(point, 7)).when(point < 0xA000, 0x68).otherwise(F.shiftright(point, 13) + 0x69)
    return F.when(F.octet_length(word) == F.length(word), 0).otherwise(block).cast("int")


def gram_rows(texts: DataFrame) -> DataFrame:
    """One row (_trusted, script, bucket) per n-gram of ``texts`` (_trusted, text); runs have script -1."""
    words = texts.select("_trusted", F.explode(word_array(F.col("text"))).alias("_w"))
    words = words.select("_trusted", script(F.col("_w")).alias("script"), word_bucket(word_hash(F.col("_w"))).alias("bucket"))
    runs = texts.select("_trusted", F.transform(runs_of(F.col("text")), lambda x: F.xxhash64(x)).alias("_h"))
    runs = runs.select("_trusted", F.explode(F.arrays_zip("_h", following("_h").alias("_g"))).alias("_at"))
    h, g = F.col("_at._h"), F.col("_at._g")
    runs = runs.select("_trusted", F.lit(-1).alias("script"), F.explode(F.array(run_bucket(h), F.when(g.isNotNull(), pair_bucket(h, g)))).alias("bucket"))
    return words.unionByName(runs.filter("bucket IS NOT NULL"))


def gram_counts(documents: DataFrame, labels: DataFrame, trusted: int = TRUSTED) -> DataFrame:
    """(script, bucket, raw, target) of every n-gram bucket that occurs, in one stored table.

    ``labels`` (doc_id, quality) names the trusted documents: those of quality 1.
    """
    ids = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy("doc_id").limit(trusted)
    ids = F.broadcast(ids.withColumn("_trusted", F.lit(1)))
    rows = gram_rows(documents.select("doc_id", "text").join(ids, "doc_id", "left").select("_trusted", "text"))
    return written(rows.groupBy("script", "bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("target")), "grams")


def weights(counts: DataFrame) -> DataFrame:
    """(bucket, weight) of every bucket that occurs: the weight in whole ``1 / UNIT``."""
    # One row per script.
    totals = F.broadcast(counts.groupBy("script").agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target")))
    # In whole millionths, so that the sum does not depend on the order of the scripts.
    expected = F.round(F.col("raw") * F.col("all_target") / F.col("all_raw") * 1e6).cast("long")
    own = counts.join(totals, "script").groupBy("bucket").agg(F.sum("target").alias("target"), (F.sum(expected) / 1e6).alias("expected"))
    weight = F.log((F.col("target") + SUPPORT) / (F.col("expected") + SUPPORT))
    return own.select("bucket", F.round(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), weight)) * UNIT).cast("int").alias("weight"))


def statistics(df: DataFrame) -> DataFrame:
    """Add ``_words``, ``_runs`` and the base statistics of ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line, F.lit(BLANKS)) != "")
    df = df.withColumns({"_words": word_array(F.col("text")), "_runs": runs_of(F.col("text")), "_lines": lines})
    # All symbols are punctuation.
    symbols = F.size(F.split(F.array_join("_runs", ""), SYMBOLS, -1)) - 1
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"), "n_symbols": symbols.cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }).drop("_lines")
    # Three-word windows by hash; those found twice are neighbours once sorted.
    df = df.withColumn("_own", F.transform("_words", lambda x: F.xxhash64(x)))
    window = lambda x, i: F.xxhash64(x, F.get("_own", i + 1), F.get("_own", i + 2))
    df = df.withColumn("_windows", F.transform(F.slice("_own", F.lit(1), F.greatest(F.size("_own") - 2, F.lit(0))), window)).drop("_own")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = lambda e, k: F.when(F.coalesce((F.get("_sorted", k - 1)["h"] == e["h"]), F.lit(False)) | F.coalesce((F.get("_sorted", k + 1)["h"] == e["h"]), F.lit(False)), e["i"])
    df = df.withColumn("_found", F.sort_array(F.filter(F.transform("_sorted", twice), lambda i: i.isNotNull()))).drop("_sorted", "_windows")
    # Places in order; each adds what the one before did not cover.
    covered = F.aggregate("_found", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")))["n"]
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_found")


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def fit(documents: DataFrame, labels: DataFrame, trusted: int = TRUSTED) -> Column:
    """The fitted weights as one constant array, a number for each bucket."""
    by_bucket = dict(weights(gram_counts(documents, labels, trusted)).select("bucket", "weight").collect())
    return F.split(F.lit(",".join(str(by_bucket.get(b, 0)) for b in range(BUCKETS + 2 * MARKS))), ",").cast("array<int>")


def judged(documents: DataFrame, model: Column, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with the statistics, score, base_failed and kept of every row."""
    weight = lambda b: F.coalesce(F.get(model, b), F.lit(0))
    known = F.aggregate("_words", F.lit(0).cast("long"), lambda s, w: s + weight(word_bucket(word_hash(w))))
    marked = F.zip_with("_hashes", following("_hashes"), lambda a, b: weight(run_bucket(a)) + weight(pair_bucket(a, b)))
    marked = F.aggregate(marked, F.lit(0).cast("long"), lambda s, x: s + x)
    score = F.when(F.col("n_words") > 0, (known + marked) / (UNIT * F.col("n_words"))).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = statistics(documents).withColumn("_hashes", F.transform("_runs", lambda x: F.xxhash64(x)))
    df = df.withColumns({"score": score, "base_failed": failed}).drop("_words", "_runs", "_hashes")
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    # A generator keeps later filters above: pushed down, they would repeat the nested expressions
    # of every step below, and planning would take exponential time.
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def op8(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, with the score."""
    model = fit(documents, labels)
    return judged(documents.select("doc_id", "text"), model).select("doc_id", *STATISTICS, "base_failed", "kept", "score")


def filtered(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    inner = documents.select(F.struct(*documents.columns).alias("_doc"), "text")
    return judged(inner, fit(documents, labels)).filter("kept").select("_doc.*")
