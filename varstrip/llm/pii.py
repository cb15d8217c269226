"""PII: detected entities, and the terms around them that give them away.

Entities (email, ip, card, phone) are found by expressions, line by line, since none of them can
contain a line break. Which other terms disclose an entity is estimated from the corpus: with
p(e) the share of the corpus' word places that are contexts of entity e, and p(e|t) the share of
term t's occurrences that are, t reveals the part

    D(e, t) = PMI(e, t) / IC(e) = 1 - log p(e|t) / log p(e)

of e's information content. Terms from ``GENERALISE`` on are generalised, from ``REMOVE`` on they
are removed. An entity counts as observed only if it has several contexts that differ somewhere, so
that copies of one page are no evidence, and a phrase that always surrounds it on unlike pages is.

Everything runs in built-in functions. Offsets come from the lengths of the text between matches,
summed by a window over one document's matches. Documents without any candidate character send one
small row through the shuffle. Term counts cover the whole corpus; occurrences that cannot be
candidates are dropped before the shuffle by a filter of at most ``FILTER`` hash buckets, which is
what is broadcast.

Defined results: a NULL or empty text has no spans; repeated rows, repeated and NULL ids are rows
like any other; entities on lines of any length are found; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varstrip.llm.store import written

# The kinds of the contract, in its order; then those of the method.
KINDS = ["email", "ip", "card", "phone", "general", "removed"]
# The contract's expressions. Possessive quantifiers and the look-behind (a run is entered at its
# start, or where the last match ended) give the same matches without trying a long run again
# from every character.
_START = r"(?:\G|(?<![{0}]))"
PATTERNS = {
    "email": _START.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _START.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ANY = "[@0-9]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTEXT = 8  # words on either side
REACH = 200  # code points they are looked for in
GENERALISE, REMOVE = 0.8, 0.95
MIN_CONTEXTS = 3
FILTER = 1 << 20


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    reversed_ = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")

    def value(d, i):
        n = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(reversed_, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """The contract's test of a match of its kind; failing matches are dropped."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    # A part with more than three digits after its zeros is over 255, however long it is.
    parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, F.concat(F.lit("0"), p)).cast("int"), F.lit(0)) <= 255))
    length = F.length(digits)
    return (
        F.when(kind == "ip", ip)
        .when(kind == "card", F.when(length.between(14, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", length.between(10, 15))
        .otherwise(True)
    )


def _matches(line: Column, kind: str) -> Column:
    """Matches of a kind in a line with the length of the text before each."""
    pattern = F.lit(PATTERNS[kind])
    # A match cannot be empty, so there is one piece more than matches.
    zipped = F.arrays_zip(F.regexp_extract_all(line, pattern, F.lit(0)).alias("m"), F.transform(F.split(line, PATTERNS[kind], -1), F.length).alias("g"))
    sign = "@" if kind == "email" else "+" if kind == "phone" else "." if kind == "ip" else None
    rows = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["m"].alias("value"), x["g"].alias("gap")))
    rows = F.filter(rows, lambda x: x["value"].isNotNull())
    return F.when(F.contains(line, F.lit(sign)), rows) if sign else F.when(line.rlike("[0-9][ -]?[0-9]"), rows)


def entities(documents: DataFrame) -> DataFrame:
    """Entities of every document with the text around them, in one stored table.

    One row per entity (row, doc_id, kind, start, end, value, left, right), and one with a NULL
    kind for every document. ``row`` tells rows of ``documents`` apart.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    line = lambda x: F.struct((F.length(x) + 1).alias("n"), F.when(x.rlike(ANY), x).alias("line"))
    lines = docs.select("row", "doc_id", F.posexplode_outer(F.when(F.col("text").rlike(ANY), F.transform(F.split("text", "\n", -1), line))).alias("ln", "x"))
    lines = lines.select("row", "doc_id", "ln", F.col("x.n").alias("n"), F.col("x.line").alias("line")).repartition("row")
    before = Window.partitionBy("row").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    none = F.array().cast("array<struct<kind:string,i:int,value:string,gap:int>>")
    found = F.concat(*[F.coalesce(_matches(F.col("line"), k), none) for k in PATTERNS])
    own = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("i"), F.lit("").alias("value"), F.lit(0).alias("gap")))
    rows = F.concat(F.when(F.col("line").isNotNull(), found).otherwise(none), F.when(F.coalesce("ln", F.lit(0)) == 0, own).otherwise(none))
    hits = lines.withColumn("x", F.explode(rows)).select("row", "doc_id", "ln", "at", "line", "x.*")
    upto = Window.partitionBy("row", "ln", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("stop", F.sum(F.col("gap") + F.length("value")).over(upto).cast("int"))
    hits = hits.withColumn("begin", F.col("stop") - F.length("value"))
    hits = hits.filter(F.col("kind").isNull() | valid(F.col("kind"), F.col("value")))
    low = F.greatest(F.lit(0), F.col("begin") - REACH)
    some = F.col("kind").isNotNull()
    out = hits.select(
        "row", "doc_id", "kind", F.when(some, F.col("at") + F.col("begin")).cast("int").alias("start"), F.when(some, F.col("at") + F.col("stop")).cast("int").alias("end"), F.when(some, F.col("value")).alias("value"),
        F.when(some, F.substring("line", low + 1, F.col("begin") - low)).alias("left"), F.when(some, F.substring("line", F.col("stop") + 1, F.lit(REACH))).alias("right"),
    )
    return written(out, "entities")


def _words_of(side: Column, base: Column) -> Column:
    """Words of a short piece of text with their offsets; ``base`` is where it begins."""
    zipped = F.arrays_zip(F.regexp_extract_all(side, F.lit(WORD), F.lit(0)).alias("m"), F.split(side, WORD, -1).alias("g"))
    none = F.array().cast("array<struct<term:string,start:int,end:int>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        word = F.struct(F.lower(x["m"]).alias("term"), start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(word)).alias("out")))

    return F.aggregate(zipped, F.struct(base.cast("int").alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def contexts(found: DataFrame) -> DataFrame:
    """Words beside each entity: (row, entity, near, words), at most ``CONTEXT`` on either side; ``near``
    is a hash of them all.

    A word cut off by the reach of the context is not one of them.
    """
    left = _words_of(F.col("left"), F.col("start") - F.length("left"))
    right = _words_of(F.col("right"), F.col("end"))
    df = found.filter("kind IS NOT NULL").select("row", F.concat_ws(":", "kind", "value").alias("entity"), "start", "end", F.length("left").alias("_l"), F.length("right").alias("_r"), left.alias("_left"), right.alias("_right"))
    whole_left = F.filter("_left", lambda w: (F.col("_l") < REACH) | (w["start"] > F.col("start") - REACH))
    whole_right = F.filter("_right", lambda w: (F.col("_r") < REACH) | (w["end"] < F.col("end") + REACH))
    df = df.withColumns({"_left": F.reverse(whole_left), "_right": whole_right})
    df = df.withColumns({"_left": F.slice("_left", 1, CONTEXT), "_right": F.slice("_right", 1, CONTEXT)})
    near = F.xxhash64(F.col("_left")["term"], F.col("_right")["term"])
    return df.select("row", "entity", near.alias("near"), F.concat("_left", "_right").alias("words"))


def disclosing(documents: DataFrame, around: DataFrame, generalise: float = GENERALISE, least: int = MIN_CONTEXTS) -> DataFrame:
    """(entity, term, disclosure) of the terms that reveal an entity to the degree ``generalise``."""
    per_near = around.groupBy("entity", "near").agg(F.count(F.lit(1)).alias("n"))
    seen = per_near.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("different"))
    seen = seen.filter(F.col("different") >= least).drop("different")
    pairs = around.join(seen, "entity").select("entity", "n_entity", F.explode(F.array_distinct(F.col("words")["term"])).alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_pair"), F.any_value("n_entity").alias("n_entity")).filter(F.col("n_pair") >= least)
    buckets = pairs.select(F.pmod(F.xxhash64("term"), F.lit(FILTER)).alias("_b")).distinct()  # at most FILTER rows
    spoken = documents.select(F.explode(F.split(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")).alias("term")).filter("term <> ''")
    total = spoken.groupBy().agg(F.count(F.lit(1)).alias("n_words"))
    chosen = spoken.withColumn("_b", F.pmod(F.xxhash64("term"), F.lit(FILTER))).join(F.broadcast(buckets), "_b", "left_semi")
    counts = chosen.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    scored = pairs.join(counts, "term").withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k")
    given = F.least(F.lit(1.0), F.col("n_pair") / F.col("n_term"))
    alone = F.least(F.lit(0.5), F.col("n_entity") * (2 * CONTEXT) / F.col("n_words"))
    scored = scored.withColumn("disclosure", 1 - F.log(given) / F.log(alone))
    return scored.filter(F.col("disclosure") >= generalise).select("entity", "term", "disclosure")


def sanitise(documents: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, least: int = MIN_CONTEXTS) -> DataFrame:
    """One row per document: doc_id and spans (start, k, end, kind) in order; k numbers the kinds.

    Entities are to be masked, ``general`` terms replaced by a class, ``removed`` ones left out.
    """
    found = entities(documents)
    around = contexts(found)
    terms = disclosing(documents, around, generalise, least)
    placed = around.select("row", "entity", F.explode("words").alias("w")).select("row", "entity", "w.*").join(terms, ["entity", "term"])
    kind = F.when(F.col("disclosure") >= remove, "removed").otherwise("general")
    placed = placed.groupBy("row", "start", "end").agg(F.max("disclosure").alias("disclosure")).select("row", F.lit(None).cast("long").alias("doc_id"), kind.alias("kind"), "start", "end")
    rows = found.select("row", "doc_id", "kind", "start", "end").unionByName(placed)
    order = sum((F.when(F.col("kind") == k, i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", order.alias("k"), "end", "kind"))
    return rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("spans")).drop("row")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5(documents: DataFrame) -> DataFrame:
    """The contract's digest of ``sanitise``."""
    spans = F.col("spans")

    def count(k: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    base = F.filter(spans, lambda s: s["k"] < 4)
    return sanitise(documents).select("doc_id", *[count(k) for k in range(4)], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))
