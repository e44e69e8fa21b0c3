"""URL filters: a temporal join of captures with dated list entries, all native.

Entries (pattern, day, action) become validity intervals: an entry holds until
the pattern's next one.  A pattern is a host, a parent domain of it or a host
with its first path segment.  A capture is judged by the entries that were
active on the day it was fetched; of several patterns the longest decides.

Both sides are dealt by (pattern, month), so neither a host with a third of all
captures nor a pattern with a third of all entries lands in one task; of the
entries of one pattern and day only the last is kept before any window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
SEGMENT = r"^[a-z][a-z0-9+.\-]*://[^/?#]*(/[^/?#]+)"


def host_of(url: Column) -> Column:
    """Lower-case host, without a final dot; '' where there is none."""
    return F.coalesce(F.rtrim(F.regexp_extract(F.lower(url), HOST, 1), F.lit(".")), F.lit(""))


def patterns_of(url: Column) -> Column:
    """All patterns that can match: the host, its parents of two labels or more, host + first segment."""
    labels = F.split(host_of(url), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)),
                          lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    path = F.regexp_extract(url, SEGMENT, 1)
    page = F.when(F.length(path) > 0, F.array(F.concat(host_of(url), path))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(parents, page), lambda p: F.length(p) > 0))


def month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until): until is null for entries still active.

    Of a pattern's entries of one day the one of the largest entry_id counts;
    entries without a pattern, a day or an action are ignored; 'remove' ends
    what was active and is no interval itself.
    """
    daily = (entries.filter("pattern is not null and pattern <> '' and day is not null and action is not null")
             .groupBy("pattern", "day").agg(F.max_by("action", "entry_id").alias("action")))
    later = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return (daily.withColumn("until", later).filter("action <> 'remove'")
            .select("pattern", "action", F.col("day").alias("since"), "until"))


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """Per row of ``captures`` (key, url, fetched): key, url, fetched, pattern, action, kept.

    Captures without an active entry, a url or a day are kept with a null
    pattern.  Extra columns are ignored; repeated rows are judged alike; empty
    lists keep everything.
    """
    seen = captures.select(F.col(key), "url", "fetched")
    # one row for each url and day, however often it was captured
    asked = (seen.filter("url is not null and fetched is not null").select("url", "fetched").distinct()
             .withColumn("pattern", F.explode(patterns_of(F.col("url")))).withColumn("m", month(F.col("fetched"))))
    last = F.lit(captures.agg(F.max("fetched")).first()[0]).cast("date")  # open intervals reach to here
    spans = intervals(entries).withColumn("m", F.explode(F.sequence(month(F.col("since")), F.greatest(
        month(F.col("since")), F.coalesce(month(F.least(F.coalesce(F.col("until"), last), last)), month(F.col("since")))))))
    hit = ((F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    active = asked.join(spans, ["pattern", "m"]).filter(hit)
    best = active.groupBy("url", "fetched").agg(
        F.max(F.struct(F.length("pattern").alias("n"), "pattern", "action")).alias("best"))
    return seen.join(best, ["url", "fetched"], "left").select(
        key, "url", "fetched", F.col("best.pattern").alias("pattern"), F.col("best.action").alias("action"),
        F.coalesce(F.col("best.action") != "block", F.lit(True)).alias("kept"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day spread over 540 days by their id (the table has none)."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 540).cast("int"))
                        .alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """One dated entry per page: its host, registered domain or first segment, blocked, allowed or removed."""
    host, labels = host_of(F.col("url")), F.split(host_of(F.col("url")), r"\.")
    kind = F.col("page_id") % 3
    pattern = (F.when(kind == 0, host).when(kind == 1, F.array_join(F.slice(labels, -2, 2), "."))
               .otherwise(F.concat(host, F.regexp_extract("url", SEGMENT, 1))))
    act = F.col("page_id") % 4
    return pages.filter(F.size(labels) > 1).select(
        F.col("page_id").alias("entry_id"), pattern.alias("pattern"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 53 % 600).cast("int")).alias("day"),
        F.when(act < 2, "block").when(act == 2, "allow").otherwise("remove").alias("action"))


URL_FILTER_SQL = r"""
WITH p AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 540 AS INTEGER) AS DATE) AS fetched,
         rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.') AS host,
         regexp_extract(url, '^[a-z][a-z0-9+.\-]*://[^/?#]*(/[^/?#]+)', 1) AS seg
  FROM pages),
e AS (
  SELECT page_id AS entry_id,
         CASE page_id % 3 WHEN 0 THEN host WHEN 1 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host || seg END AS pattern,
         CAST(DATE '2024-01-01' + CAST(page_id * 53 % 600 AS INTEGER) AS DATE) AS day,
         CASE WHEN page_id % 4 < 2 THEN 'block' WHEN page_id % 4 = 2 THEN 'allow' ELSE 'remove' END AS action
  FROM p WHERE len(string_split(host, '.')) > 1),
d AS (SELECT pattern, day, arg_max(action, entry_id) AS action FROM e WHERE pattern <> '' GROUP BY pattern, day),
i AS (SELECT *, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until FROM d),
k AS (
  SELECT DISTINCT url, fetched, array_to_string(string_split(host, '.')[j:], '.') AS pattern
  FROM p, generate_series(1, 20) AS g(j) WHERE j <= greatest(1, len(string_split(host, '.')) - 1) AND host <> ''
  UNION SELECT DISTINCT url, fetched, host || seg FROM p WHERE seg <> ''),
b AS (
  SELECT k.url, k.fetched, i.pattern, i.action,
         row_number() OVER (PARTITION BY k.url, k.fetched ORDER BY length(i.pattern) DESC, i.pattern DESC) AS n
  FROM k JOIN i ON i.pattern = k.pattern AND i.action <> 'remove' AND k.fetched >= i.day AND (i.until IS NULL OR k.fetched < i.until))
SELECT p.page_id, p.url, p.fetched, b.pattern, b.action, coalesce(b.action <> 'block', true) AS kept
FROM p LEFT JOIN b ON b.url = p.url AND b.fetched = p.fetched AND b.n = 1
"""
