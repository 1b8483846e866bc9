"""URL filter: temporal list join.

A list is a log of dated entries: an entry (a domain or a URL prefix) is added to a named list and may be
removed later. The log becomes validity intervals, and every capture is held against the entries that were
active when it was fetched.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A small list log for the demonstration query: list, kind, entry, action, day.
DEMO_LOG = [
    ("spam", "domain", "spam-farm.example.org", "add", "2024-02-01"),
    ("spam", "domain", "cheap-pills.example.com", "add", "2024-01-15"),
    ("spam", "domain", "cheap-pills.example.com", "remove", "2024-06-01"),
    ("spam", "domain", "cheap-pills.example.com", "add", "2024-09-01"),
    ("mirror", "domain", "tionsh.example.net", "add", "2024-03-10"),
    ("mirror", "domain", "tionsh.example.net", "remove", "2024-04-10"),
    ("mirror", "domain", "tionsh.example.com", "add", "2024-05-01"),
    ("review", "prefix", "ththan.example.com/en", "add", "2024-01-01"),
    ("review", "prefix", "ththan.example.com/en", "remove", "2024-08-01"),
    ("review", "prefix", "tionble.example.org/en", "add", "2024-07-01"),
]
#: Interval rows up to which the list side is broadcast; a longer list is joined by shuffle.
BROADCAST_ROWS = 200_000


def demo_log(spark: SparkSession) -> DataFrame:
    rows = [(a, b, c, d, dt.date.fromisoformat(e)) for a, b, c, d, e in DEMO_LOG]
    return spark.createDataFrame(rows, "list string, kind string, entry string, action string, day date")


def validity_intervals(log: DataFrame) -> DataFrame:
    """(list, key, entry, valid_from, valid_to): each entry from an add up to, not including, its next event.

    Of events on one day a removal counts last. valid_to is null while the entry is active. Entries without a
    dot in their host, null entries and null days are void.
    """
    host = F.lower(F.substring_index(F.trim("entry"), "/", 1))
    rest = F.regexp_replace(F.regexp_extract(F.trim("entry"), r"^[^/]*(/.*)?$", 1), "/+$", "")
    named = log.select("list", F.trim("entry").alias("entry"), "day", "action", F.when(F.col("kind") == "prefix", F.concat(F.lit("p:"), host, rest)).otherwise(F.concat(F.lit("d:"), host)).alias("key"))
    named = named.filter(F.col("day").isNotNull() & F.col("key").contains("."))
    w = Window.partitionBy("list", "key").orderBy("day", F.when(F.col("action") == "remove", 1).otherwise(0))
    return named.withColumn("valid_to", F.lead("day").over(w)).filter("action = 'add' and (valid_to is null or valid_to > day)").select("list", "key", "entry", F.col("day").alias("valid_from"), "valid_to")


def url_host(url) -> F.Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def url_path(url) -> F.Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def _keys() -> F.Column:
    """Every key of a list that could cover the URL: its host's suffixes of two labels or more, its path prefixes."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    domains = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.lit("d:"), F.concat_ws(".", F.slice(labels, i, n))))).otherwise(F.array().cast("array<string>"))
    steps = F.array_remove(F.split("path", "/"), "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.concat(F.lit("p:"), F.concat_ws("/", F.array(F.col("host")), F.slice(steps, 1, i))))
    return F.array_distinct(F.concat(domains, prefixes))


def temporal_list_join(captures: DataFrame, log: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per distinct capture (page_id, url, fetched date) of ``captures``, with what was active then.

    Result: page_id, url, host, fetched, blocked, n_entries, entries (sorted, joined by |), lists (likewise).
    Domain entries cover their subdomains, prefix entries whole path segments of exactly that host. A null or
    malformed URL has the host '' and is never blocked; a null fetch date meets no interval. Repeated rows
    count once; an empty list or table blocks nothing. Further columns of either input are ignored.
    """
    spans = validity_intervals(log).withColumnRenamed("key", "_key")
    if len(spans.limit(broadcast_rows + 1).select(F.lit(1)).tail(broadcast_rows + 1)) <= broadcast_rows:
        spans = F.broadcast(spans)
    url = F.coalesce(F.col("url"), F.lit(""))
    base = captures.select("page_id", "url", "fetched").distinct().withColumns({"host": url_host(url), "path": url_path(url)})
    hits = base.select("page_id", "url", "fetched", F.explode(_keys()).alias("_key")).join(spans, "_key").filter("fetched >= valid_from and (valid_to is null or fetched < valid_to)")
    found = hits.groupBy(F.col("page_id").alias("_page"), F.col("url").alias("_url"), F.col("fetched").alias("_day")).agg(F.count("*").alias("n"), F.concat_ws("|", F.array_sort(F.collect_set("entry"))).alias("e"), F.concat_ws("|", F.array_sort(F.collect_set("list"))).alias("l"))
    same = F.col("page_id").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url")) & (F.col("fetched") == F.col("_day"))
    return base.join(found, same, "left").select("page_id", "url", "host", "fetched", F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("e", F.lit("")).alias("entries"), F.coalesce("l", F.lit("")).alias("lists"))


def captures_of(pages: DataFrame) -> DataFrame:
    """``pages`` has no fetch time; the query gives each page a day of 2024 that follows from its id."""
    return pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 7, 366) as int))").alias("fetched"))
