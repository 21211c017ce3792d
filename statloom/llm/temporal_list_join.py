"""URL filtering against dated lists, as of the time each page was fetched.

A list is a stream of dated entries (domain, action add or remove, at).  Entries become
validity intervals: each holds from its time until the domain's next entry.  A capture is
listed if the host or a parent domain of it has an added entry in force when it was
fetched; the longest such domain counts.

What is asked are the distinct pairs of host and time, under the host and each of its parent
domains.  They meet the intervals by domain and by the ``SPAN`` of time they lie in, so that a
domain with a third of all captures is spread over its spans; within a span the as-of condition
decides.  An interval is known in the span it begins in, and is carried into those later spans
that are asked for its domain: intervals of a domain do not overlap, so one at most is carried
into each, and there are never more rows than entries and asked spans, however long an interval
lasts or how far off a time is.  The best entry of each pair is then looked up by the captures.

Defined results: a url without host, a null url or a null time is not listed; at equal
times of one domain a removal comes after an addition; entries with nulls are passed over;
captures that repeat each get a row; an empty list lists nothing; where nothing is listed entry
and since are null; columns host, listed, entry and since of the captures are replaced, all
others kept, whatever their names; times are any whole numbers of 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, stage

#: Seconds of a span of time.
SPAN = 32 * 86_400


def host_of(url: Column) -> Column:
    """The lower-case host of a url, null without one: no user, port or final dot."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def validity(entries: DataFrame) -> DataFrame:
    """domain, since and until (null: still) of the added entries; times in seconds."""
    known = entries.where("domain is not null and action in ('add', 'remove') and at is not null")
    line = Window.partitionBy("domain").orderBy("at", "action")
    spans = known.select(F.lower("domain").alias("domain"), "action", F.col("at").cast("long").alias("at"))
    spans = spans.withColumn("until", F.lead("at").over(line))
    return spans.where("action = 'add' and (until is null or until > at)").select("domain", F.col("at").alias("since"), "until")


def span_of(name: str) -> Column:
    """The number of the span that a time lies in, exact for every long."""
    return F.expr(f"({name} div {SPAN}) - if({name} < 0 and {name} % {SPAN} <> 0, 1, 0)").alias("span")


def intervals_by_span(intervals: DataFrame, asked: DataFrame) -> DataFrame:
    """(domain, span, since, until) of the intervals, in the span where each begins and in the later ones asked (domain, span) that it may reach."""
    none = F.lit(None).cast("long")
    begun = intervals.select("domain", span_of("since"), "since", "until")
    known = asked.join(intervals.select("domain").distinct(), "domain", "left_semi")
    line = known.select("domain", "span", none.alias("since"), none.alias("until")).unionByName(begun)
    before = Window.partitionBy("domain").orderBy("span", F.asc_nulls_first("since")).rowsBetween(Window.unboundedPreceding, -1)
    carry = F.last(F.when(F.col("since").isNotNull(), F.struct("since", "until")), ignorenulls=True).over(before)
    carried = line.withColumn("carry", carry).where("since is null and carry is not null").select("domain", "span", "carry.since", "carry.until")
    return begun.unionByName(carried.where(F.col("until").isNull() | (span_of("until") >= F.col("span"))))


def listed_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures (url, fetched_at in seconds, other columns) with host, listed, entry and since."""
    rows = captures.select(F.struct("*").alias("row"), host_of(F.col("url")).alias("host"), F.col("fetched_at").cast("long").alias("at"))
    pairs = rows.where("host is not null and at is not null").select("host", "at").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = pairs.select("host", "at", span_of("at"), F.explode(parents).alias("domain"))
    intervals = stage(intervals_by_span(validity(entries), asked.select("domain", "span").distinct()), "intervals")
    known = F.broadcast(intervals) if intervals.count() <= BROADCAST_ROWS else intervals
    active = asked.join(known, ["domain", "span"]).where("since <= at and (until is null or at < until)")
    best = active.groupBy("host", "at").agg(F.max(F.struct(F.length("domain").alias("length"), "domain", "since")).alias("hit"))
    joined = rows.join(stage(best, "hits"), ["host", "at"], "left")  # plain tables, so that a hot host can be split
    kept = [F.col("row")[c].alias(c) for c in captures.columns if c not in ("host", "listed", "entry", "since")]
    return joined.select(*kept, "host", F.col("hit").isNotNull().alias("listed"), F.col("hit.domain").alias("entry"), F.col("hit.since").alias("since"))


DAY = 86_400
FIRST = 1_704_067_200  # 2024-01-01


def captures_of(pages: DataFrame) -> DataFrame:
    """page_id, url and a fetch time within 2024, as the pages have none of their own."""
    return pages.select("page_id", "url", (F.lit(FIRST) + F.pmod(F.col("page_id") * 7919 * 60, F.lit(366 * DAY))).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list of the hosts themselves: a quarter is added, half of these removed, some added again.

    Which and when follows from a digest of the host, so the list grows with the hosts.
    """
    hosts = pages.select(host_of(F.col("url")).alias("domain")).where("domain is not null").distinct()
    part = lambda at: F.conv(F.substring(F.md5("domain"), at, 4), 16, 10).cast("long")
    day = FIRST + (part(1) % 200) * DAY
    chosen = hosts.select("domain", day.alias("day"), part(5).alias("kind"), (part(9) % 90 + 1).alias("days"))
    chosen = chosen.where("kind % 4 = 0 or domain like '%pills%'")
    entry = lambda action, at: F.struct(F.lit(action).alias("action"), at.alias("at"))
    later = F.col("day") + F.col("days") * DAY
    steps = F.array(entry("add", F.col("day")), entry("remove", later), entry("add", later + 30 * DAY))
    upto = F.when(F.col("kind") % 8 < 4, 1).when(F.col("kind") % 16 < 8, 2).otherwise(3)
    return chosen.select("domain", F.inline(F.slice(steps, F.lit(1), upto)))


ORACLE_SQL = r"""
WITH cap AS (
  SELECT page_id, url, 1704067200 + (page_id * 7919 * 60) % (366 * 86400) AS fetched_at,
    nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.$', ''), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host AS domain FROM cap WHERE host IS NOT NULL),
parts AS (
  SELECT domain, CAST('0x' || substr(md5(domain), 1, 4) AS BIGINT) AS a, CAST('0x' || substr(md5(domain), 5, 4) AS BIGINT) AS kind,
    CAST('0x' || substr(md5(domain), 9, 4) AS BIGINT) % 90 + 1 AS days FROM hosts),
chosen AS (SELECT domain, 1704067200 + (a % 200) * 86400 AS day, kind, days FROM parts WHERE kind % 4 = 0 OR domain LIKE '%pills%'),
entries AS (
  SELECT domain, 'add' AS action, day AS moment FROM chosen
  UNION ALL SELECT domain, 'remove', day + days * 86400 FROM chosen WHERE kind % 8 >= 4
  UNION ALL SELECT domain, 'add', day + (days + 30) * 86400 FROM chosen WHERE kind % 16 >= 8 AND kind % 8 >= 4),
spans AS (
  SELECT domain, action, moment AS since, lead(moment) OVER (PARTITION BY domain ORDER BY moment, action) AS until FROM entries),
hits AS (
  SELECT c.page_id, s.domain, s.since, row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.domain) DESC, s.domain DESC, s.since DESC) AS n
  FROM cap c JOIN spans s ON (c.host = s.domain OR c.host LIKE '%.' || s.domain)
  WHERE s.action = 'add' AND s.since <= c.fetched_at AND (s.until IS NULL OR c.fetched_at < s.until))
SELECT c.page_id, c.url, c.fetched_at, c.host, h.page_id IS NOT NULL AS listed, h.domain AS entry, h.since
FROM cap c LEFT JOIN hits h ON c.page_id = h.page_id AND h.n = 1
"""
