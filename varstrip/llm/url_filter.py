"""URL filters: every capture is judged by the list entries that were active when it was fetched.

List entries are dated events per host or domain. They become validity intervals, one per change,
and an as-of join finds for each capture the entry of every enclosing domain that was active at
fetch time; the most specific one decides. There is no range join: intervals are cut into months,
and captures meet them on (domain, month). Events are reduced to one per domain and day first, so
the window over a domain's events is bounded by days and not by rows. A host with a third of all
captures is split by the skewed-join handling of adaptive execution, since nothing but the join
needs its rows together. Only built-in functions are used.

Defined results: a NULL or unparsable URL, or a host of more than 253 characters, has no host and
matches nothing; a capture without a fetch date has no active entry; several events of a domain on
one day count as the strictest (block over allow over none); repeated captures keep their rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
ACTIONS = ["none", "allow", "block"]  # in the order of strictness; none ends an entry


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, or NULL."""
    host = F.rtrim(F.regexp_extract(F.lower(url), HOST, 1), F.lit("."))
    return F.when((host != "") & (F.length(host) <= 253), host)


def domains(host: Column) -> Column:
    """The host and every enclosing domain of at least two labels."""
    labels = F.split(host, r"\.", -1)
    tail = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), tail)


def intervals(events: DataFrame) -> DataFrame:
    """Validity intervals of dated events (domain, listed, action): [since, until), until may be NULL."""
    rank = sum((F.when(F.col("action") == a, i).otherwise(0) for i, a in enumerate(ACTIONS)), F.lit(0))
    days = events.filter("domain IS NOT NULL AND listed IS NOT NULL").groupBy("domain", "listed").agg(F.max(rank).alias("_rank"))
    until = F.lead("listed").over(Window.partitionBy("domain").orderBy("listed"))
    out = days.withColumn("until", until).filter("_rank > 0")
    return out.select("domain", F.col("listed").alias("since"), "until", F.when(F.col("_rank") == 2, "block").otherwise("allow").alias("action"))


def judged(captures: DataFrame, events: DataFrame) -> DataFrame:
    """One row per capture (page_id, url, fetched) with its verdict.

    Adds host, n_active (domains with an active entry), entry (the most specific of them), since,
    action and blocked. Open intervals last until the day of the last capture.
    """
    month = lambda d: F.trunc(d, "month")
    # One row.
    last = F.broadcast(captures.agg(F.max("fetched").alias("_last")).withColumn("_k", F.lit(1)))
    cut = intervals(events).withColumn("_k", F.lit(1)).join(last, "_k").filter("since <= _last").drop("_k")
    end = F.least("_last", F.coalesce(F.date_sub("until", 1), F.col("_last")))
    cut = cut.withColumn("_month", F.explode(F.sequence(month(F.col("since")), month(end), F.expr("interval 1 month")))).drop("_last")
    rows = captures.select("page_id", "fetched", host_of(F.col("url")).alias("host")).withColumn("_row", F.monotonically_increasing_id())
    asked = rows.withColumns({"domain": F.explode_outer(domains(F.col("host"))), "_month": month(F.col("fetched"))})
    active = (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    met = asked.join(cut, ["domain", "_month"], "left").withColumn("_active", F.coalesce(active, F.lit(False)))
    best = F.max(F.when(F.col("_active"), F.struct(F.length("domain").alias("n"), "domain", "since", "action")))
    out = met.groupBy("_row", "page_id", "host", "fetched").agg(F.count_if("_active").alias("n_active"), best.alias("_best"))
    return out.select(
        "page_id", "host", "fetched", "n_active", F.col("_best.domain").alias("entry"), F.col("_best.since").alias("since"),
        F.coalesce("_best.action", F.lit("none")).alias("action"), F.coalesce(F.col("_best.action") == "block", F.lit(False)).alias("blocked"),
    )


# The test tables have no fetch dates and no list, so both are derived from the pages.
FIRST_DAY, DAYS = "2024-01-01", 366


def _number(x: Column, k: int) -> Column:
    """A number from 0 to 65535 that any engine can compute."""
    return F.conv(F.substring(F.md5(F.concat(x, F.lit(f"#{k}"))), 1, 4), 16, 10).cast("int")


def op7(pages: DataFrame) -> DataFrame:
    """Captures judged by a list of their own hosts and domains.

    A page is fetched on day page_id mod ``DAYS``. Every third host or domain is listed: blocked or
    allowed on one day, changed to the other on a later one, and every second taken off again.
    """
    first = F.to_date(F.lit(FIRST_DAY))
    captures = pages.select("page_id", "url", F.date_add(first, F.pmod(F.col("page_id"), F.lit(DAYS)).cast("int")).alias("fetched"))
    names = pages.select(F.explode(domains(host_of(F.col("url")))).alias("domain")).distinct().filter(_number(F.col("domain"), 0) % 3 == 0)
    turn = _number(F.col("domain"), 1) % 2 == 0
    day = lambda k, span: F.date_add(first, _number(F.col("domain"), k) % span)
    event = lambda listed, action: F.struct(listed.alias("listed"), action.alias("action"))
    events = F.array(
        event(day(2, 120), F.when(turn, "block").otherwise("allow")),
        event(F.date_add(day(3, 120), 120), F.when(turn, "allow").otherwise("block")),
        event(F.date_add(day(4, 240), 240), F.when(_number(F.col("domain"), 5) % 2 == 0, "none").otherwise("block")),
    )
    listed = names.select("domain", F.inline(events))
    return judged(captures, listed)


OP7_SQL = """
WITH p AS (
  SELECT page_id, row_number() OVER () AS rid, DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS fetched,
         rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.') AS h
  FROM pages
), c AS (SELECT page_id, rid, fetched, CASE WHEN h <> '' AND length(h) <= 253 THEN h END AS host FROM p),
d AS (
  SELECT DISTINCT rid, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS domain
  FROM (SELECT rid, host, unnest(range(1, greatest(1, len(string_split(host, '.')) - 1) + 1)) AS i FROM c WHERE host IS NOT NULL)
), n AS (
  SELECT domain, list_transform([0, 1, 2, 3, 4, 5], lambda k: CAST('0x' || substr(md5(domain || '#' || k), 1, 4) AS INTEGER)) AS r
  FROM (SELECT DISTINCT domain FROM d)
), e AS (
  SELECT domain, DATE '2024-01-01' + r[3] % 120 AS listed, CASE WHEN r[2] % 2 = 0 THEN 2 ELSE 1 END AS rank FROM n WHERE r[1] % 3 = 0
  UNION ALL SELECT domain, DATE '2024-01-01' + 120 + r[4] % 120, CASE WHEN r[2] % 2 = 0 THEN 1 ELSE 2 END FROM n WHERE r[1] % 3 = 0
  UNION ALL SELECT domain, DATE '2024-01-01' + 240 + r[5] % 240, CASE WHEN r[6] % 2 = 0 THEN 0 ELSE 2 END FROM n WHERE r[1] % 3 = 0
), m AS (SELECT domain, listed, max(rank) AS rank FROM e GROUP BY ALL),
v AS (SELECT *, lead(listed) OVER (PARTITION BY domain ORDER BY listed) AS until FROM m),
hit AS (
  SELECT c.rid, count(*) AS n_active, max({'n': length(d.domain), 'domain': d.domain, 'since': v.listed, 'rank': v.rank}) AS best
  FROM c JOIN d ON c.rid = d.rid JOIN v ON v.domain = d.domain AND v.rank > 0 AND c.fetched >= v.listed AND (v.until IS NULL OR c.fetched < v.until)
  GROUP BY c.rid
)
SELECT c.page_id, c.host, c.fetched, coalesce(hit.n_active, 0) AS n_active, hit.best.domain AS entry, hit.best.since AS since,
       CASE hit.best.rank WHEN 2 THEN 'block' WHEN 1 THEN 'allow' ELSE 'none' END AS action, coalesce(hit.best.rank = 2, false) AS blocked
FROM c LEFT JOIN hit ON c.rid = hit.rid
"""
