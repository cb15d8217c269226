"""Filter interaction audit: what each of several filters removes, alone, in every order, and in fairness.

Every document gets the set of filters that it fails, as bits. All that is asked about orders then
follows from the *coalition removals* v(S), the number of documents that fail a filter of S: they are
tabulated for all 2^n sets S per part, of all, good and toxic documents. A filter applied after the
set P removes v(P + itself) - v(P). Its fair share is its Shapley value, found as the solution of the
kernel-weighted least-squares problem

    minimise  sum over S of k(S) (v(S) - sum of phi over S)^2   with   sum of phi = v(all)

whose normal equations with the efficiency constraint are solved in rationals. They depend on n
alone, so they are solved once for unit removals; a part's values are integer combinations of its v.

A text is read once, and one small row per document is stored. Documents are compared by the SHA-256
of their texts; a text's smallest id is a map-side aggregation and is joined back on (text, id), so
no copy group comes together anywhere. Sums are pre-aggregated per part; a part has at most 2^n sums.

Defined results: a NULL text is the empty text, which fails A (and E beside a smaller id); a NULL
``lang`` is the part ''; a NULL ``doc_id`` is smaller than none, so it never fails E nor makes others
fail, and has no label; repeated rows count each and do not make each other fail E; of several labels
of one id any 1 counts; an empty table has no parts; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrip.llm.quality_rules import word_array
from varstrip.llm.store import written

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 3
# Failure conditions on (text, words, number of words); duplicates are judged across the table.
RULES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "A": lambda text, words, n: n < MIN_WORDS,
    "B": lambda text, words, n: 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n,
    "C": lambda text, words, n: 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITAL_PERCENT * F.length(text),
    "D": lambda text, words, n: text.rlike("[#$%&*|]"),
}
DUPLICATE = "E"
FILTERS = "".join(RULES) + DUPLICATE


def kernel(n: int, size: int) -> Fraction:
    """Weight of a coalition of the given size, neither empty nor whole."""
    return Fraction(n - 1, math.comb(n, size) * size * (n - size))


def solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """Exact solution of a regular system for several right-hand sides at once."""
    rows = [[*a, *b] for a, b in zip(matrix, right, strict=True)]
    n = len(rows)
    for k in range(n):
        pivot = next(i for i in range(k, n) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k], strict=True)]
    return [row[n:] for row in rows]


def shapley_weights(n: int) -> list[list[Fraction]]:
    """For each of n players the weights of v(0), v(1), ... v(2^n - 1) in their Shapley value.

    Unknowns of the normal equations are the values and the multiplier of the constraint.
    """
    full = (1 << n) - 1
    matrix = [[Fraction(int(n in (i, j) and i != j)) for j in range(n + 1)] for i in range(n + 1)]
    right = [[Fraction(int(i == n and s == full)) for s in range(full + 1)] for i in range(n + 1)]
    for s in range(1, full):
        members = [i for i in range(n) if s >> i & 1]
        weight = kernel(n, len(members))
        for i in members:
            right[i][s] += weight
            for j in members:
                matrix[i][j] += weight
    return solved(matrix, right)[:n]


def failures(documents: DataFrame, part: str = "lang", rules: dict = RULES) -> DataFrame:
    """One stored row per document: doc_id, part, digest of its text, and the rules it fails as bits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = documents.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    df = df.withColumn("_words", word_array(F.col("_text"))).withColumn("_n", F.size("_words"))
    bits = [F.when(rule(F.col("_text"), F.col("_words"), F.col("_n")), 1 << i).otherwise(0) for i, rule in enumerate(rules.values())]
    mask = sum(bits[1:], bits[0]).cast("int").alias("mask")
    return written(df.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), mask), "failures")


def with_duplicates(failed: DataFrame, bit: int) -> DataFrame:
    """``failed`` with one more bit for rows whose text a smaller id has too."""
    first = failed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    df = failed.join(first.filter("doc_id IS NOT NULL"), ["digest", "doc_id"], "left")
    later = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    return df.withColumn("mask", F.col("mask") + F.when(later, 1 << bit).otherwise(0)).drop("_first")


def coalition_removals(failed: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Per part, the total and ``v``: by number of the coalition, its removals (all, good, toxic)."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality").alias("_good"), one("toxic").alias("_toxic"))
    sums = failed.join(marks, "doc_id", "left").groupBy("part", "mask")
    sums = sums.agg(F.count(F.lit(1)).alias("all"), F.coalesce(F.sum("_good"), F.lit(0)).alias("good"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("toxic"))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    removed = [F.sum(F.when(hit, F.col(c)).otherwise(0)).cast("long").alias(c) for c in ("all", "good", "toxic")]
    table = sums.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    table = table.groupBy("part", "coalition").agg(F.sum("all").cast("long").alias("n_docs"), *removed)
    cells = F.transform(F.sort_array(F.collect_list(F.struct("coalition", "all", "good", "toxic"))), lambda x: F.struct(x["all"].alias("all"), x["good"].alias("good"), x["toxic"].alias("toxic")))
    return table.groupBy("part", "n_docs").agg(cells.alias("v"))


def audit(removals: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step."""
    n = len(filters)
    scale = math.factorial(n)
    # n! times a Shapley weight is whole: the sum over all orders.
    weights = [[int(w * scale) for w in row] for row in shapley_weights(n)]
    share = F.array(*[sum((w * F.col("v")[s]["all"] for s, w in enumerate(row) if w), F.lit(0).cast("long")) for row in weights])
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    df = removals.withColumn("_share", share).withColumn("filter_order", F.explode(orders))
    df = df.withColumn("_bits", F.transform(F.split("filter_order", ""), lambda x: F.instr(F.lit(filters), x) - 1))
    df = df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    union = lambda k: F.aggregate(F.slice("_bits", 1, k), F.lit(0), lambda m, b: m + F.call_function("shiftleft", F.lit(1), b))
    df = df.withColumns({"_own": F.get("_bits", F.col("step") - 1), "_before": union(F.col("step") - 1), "_after": union(F.col("step"))})
    full = (1 << n) - 1
    v = lambda s, c="all": F.get("v", s)[c]
    own = F.call_function("shiftleft", F.lit(1), F.col("_own"))
    gain = lambda c: v(F.col("_after"), c) - v(F.col("_before"), c)
    return df.select(
        "part", "filter_order", "step", (F.col("n_docs") - v(F.col("_after"))).alias("kept"), gain("all").alias("removed"), (v(own) - gain("all")).alias("redundant"),
        (v(F.lit(full)) - v(F.lit(full) - own)).alias("unique_fails"), gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"), F.get("_share", F.col("_own")).alias("shapley"),
        F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"),
    )


def op11(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, with the letter of the step's filter."""
    failed = with_duplicates(failures(documents), len(RULES))
    return audit(coalition_removals(failed, labels, len(FILTERS)))


# Every order is walked, every document is judged at every step.
OP11_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents
), worded AS (
  SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY body) AS first_id FROM base
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_extract_all(body, '[A-Z]')) > 3 * length(body) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS fails
  FROM worded LEFT JOIN marks USING (doc_id)
), grouped AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier FROM orders, range(1, 6) AS r(step)),
walked AS (
  SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS hit, fails = letter AS alone,
    len(translate(fails, earlier, '')) < len(fails) AS gone
  FROM grouped, steps
), counted AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN hit OR gone THEN 0 ELSE n END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM walked GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley, letter AS filter
FROM counted
"""
