"""URL lists with dates: every capture is judged by the entries active when it was fetched.

List entries are dated additions and removals of a pattern: a domain (`host.tld`, which holds
for its subdomains, too) or a place on a host (`host/segment`). They become validity intervals
[from, to), `to` null while active. Several entries of one pattern and day count as one, and an
addition outweighs a removal; so a pattern has at most one change a day, whatever the number of
its entries. Captures are joined by site (host and first path segment), not one by one with
their patterns: what all captures of a site share is looked up once.

Null or unreadable URLs have no site and match nothing; a capture without a date matches
nothing. The join is exact; a site with very many captures is on the left only, and unique on
the right, so Spark may split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SEGMENT = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([^/?#]*)"


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(found != "", F.regexp_replace(found, r"\.+$", ""))


def site_of(url: Column) -> Column:
    """host/first segment, or null."""
    return F.concat(host_of(url), F.lit("/"), F.regexp_extract(url, SEGMENT, 1))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (list, pattern, on date, added boolean) to (list, pattern, from, to)."""
    daily = (
        entries.filter("list is not null and pattern is not null and on is not null")
        .groupBy("list", "pattern", "on")
        .agg(F.max(F.coalesce("added", F.lit(False))).alias("added"))
    )
    by = Window.partitionBy("list", "pattern").orderBy("on")
    changes = daily.withColumn("was", F.coalesce(F.lag("added").over(by), F.lit(False)))
    changes = changes.filter("added <> was")  # additions and removals now alternate
    spans = changes.withColumn("to", F.lead("on").over(by)).filter("added")
    return spans.select("list", "pattern", F.col("on").alias("from"), "to")


def patterns_of(site: Column) -> Column:
    """The patterns that can match a site: itself, its host, and every parent domain."""
    host = F.substring_index(site, "/", 1)
    parts = F.split(host, r"\.")
    tails = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    return F.array_distinct(F.concat(tails, F.array(site)))


def judged(captures: DataFrame, entries: DataFrame, url: str = "url", on: str = "fetched_on") -> DataFrame:
    """captures with `matches`: the entries (list, pattern, from, to) active on the day of the
    fetch, sorted. Other columns of captures stay as they are; one named `matches` is
    replaced."""
    known = captures.withColumn("_site", site_of(captures[url]))
    sites = known.select("_site").filter("_site is not null").distinct()
    spans = intervals(entries).select(
        F.col("pattern").alias("_pattern"), F.struct("list", "pattern", "from", "to").alias("_span")
    )
    listed = (
        sites.withColumn("_pattern", F.explode(patterns_of(F.col("_site"))))
        .join(spans, "_pattern")
        .groupBy("_site")
        .agg(F.array_sort(F.collect_list("_span")).alias("_spans"))
    )
    day = captures[on]
    active = F.filter(
        "_spans", lambda s: (s["from"] <= day) & (s["to"].isNull() | (day < s["to"]))
    )
    joined = known.join(listed, "_site", "left")
    joined = joined.drop("matches").withColumn("matches", F.coalesce(active, F.array()))
    return joined.select(
        *(captures[c] for c in captures.columns if c != "matches"), "matches"
    )
