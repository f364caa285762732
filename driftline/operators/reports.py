"""Reports over the document table and the crawl log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The status of a failed connection, slow down, gone.
FAILED, SLOW_DOWN, GONE = 49, 44, 52
#: First wait, longest wait (ms), tries; samples and share of failures that mark a site down.
FIRST_WAIT, LONGEST_WAIT, RETRIES = 200, 60_000, 5
SAMPLES, DOWN_SHARE = 10, 0.7


def known_hosts(documents: DataFrame, favicons: DataFrame) -> DataFrame:
    hosts = documents.where(F.col("status_code") != FAILED).groupBy("protocol", "domain", "port").agg(F.count("*").alias("urls"), F.max("last_time_updated").alias("last_update"))
    return hosts.join(favicons.select("protocol", "domain", "port", "emoji"), ["protocol", "domain", "port"], "left")


def with_favicon(rows: DataFrame, favicons: DataFrame) -> DataFrame:
    return rows.join(favicons.select("protocol", "domain", "port", "emoji"), ["protocol", "domain", "port"], "left")


def favicon_popularity(favicons: DataFrame) -> DataFrame:
    return favicons.groupBy("emoji").agg(F.count("*").alias("sites")).orderBy(F.desc("sites"), "emoji")


def unreachable(documents: DataFrame, domain: str) -> DataFrame:
    return documents.where((F.col("domain") == domain) & ~F.col("is_available")).orderBy("meta", "url")


def failing(documents: DataFrame, domain: str) -> DataFrame:
    status = F.col("status_code")
    return documents.where((F.col("domain") == domain) & F.col("is_available") & (status >= 40) & (status < 60) & (status != GONE)).orderBy("status_code", "url")


def gone(documents: DataFrame, domain: str) -> DataFrame:
    return documents.where((F.col("domain") == domain) & (F.col("status_code") == GONE)).orderBy("url")


def search_statistics(documents: DataFrame) -> DataFrame:
    """One row: sites reached, URLs, URLs with content, last visit."""
    site = F.when(F.col("status_code") != FAILED, F.struct("domain", "port"))
    return documents.agg(F.countDistinct(site).alias("domains"), F.count("*").alias("urls"), F.count_if(F.col("status_code") == 20).alias("success_urls"), F.max("last_visit").alias("last_updated"))


def mime_statistics(records: DataFrame, cap: int = 100 * 1024) -> DataFrame:
    """Per MIME type: count, size, and what a size cap would save."""
    return records.where("mime_type is not null").groupBy("mime_type").agg(F.count("*").alias("n"), F.sum("size").alias("total_size"), F.sum(F.greatest(F.col("size") - cap, F.lit(0))).alias("savings")).orderBy("n", "mime_type")


def bag(rows: DataFrame, item: str, at_least: int = 1) -> DataFrame:
    return rows.groupBy(item).agg(F.count("*").alias("n")).where(F.col("n") >= at_least).orderBy(F.desc("n"), item)


def has_failures(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status_code") == FAILED).select("authority").distinct()


def of_failing_sites(rows: DataFrame) -> DataFrame:
    return rows.join(has_failures(rows), "authority", "left_semi")


def of_sound_sites(rows: DataFrame) -> DataFrame:
    return rows.join(has_failures(rows), "authority", "left_anti")


def connectivity(log: DataFrame, samples: int = SAMPLES, share: float = DOWN_SHARE) -> DataFrame:
    """``log`` (authority, seq, failed, terminal) with down: a terminal error so far, or too many of the last failed."""
    w = Window.partitionBy("authority").orderBy("seq")
    last = w.rowsBetween(1 - samples, 0)
    failing_ = (F.count("*").over(last) >= samples) & (F.avg(F.col("failed").cast("int")).over(last) > share)
    stuck = F.max(F.col("terminal").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return log.withColumn("down", stuck | failing_)


def politeness(log: DataFrame) -> DataFrame:
    """``log`` (authority, seq, status_code) with wait_ms: doubled by each slow-down answer so far, up to a minute."""
    w = Window.partitionBy("authority").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum((F.col("status_code") == SLOW_DOWN).cast("int")).over(w)
    return log.withColumn("wait_ms", F.least(F.lit(LONGEST_WAIT), F.lit(FIRST_WAIT) * F.pow(F.lit(2), F.least(n, F.lit(20)))).cast("long"))


def first_seen_by_site(documents: DataFrame) -> DataFrame:
    return documents.groupBy("domain", "port").agg(F.min("first_seen").alias("first_seen"))


def special_captures(sites: DataFrame, documents: DataFrame) -> DataFrame:
    """Reachable sites' stored texts as captures, a row per text, dated by the site's first document."""
    cols = "stack(3, '/favicon.txt', favicon_text, '/robots.txt', robots_text, '/.well-known/security.txt', security_text) as (path, content)"
    rows = sites.where("is_reachable").selectExpr("domain", "port", cols).where("content is not null")
    return rows.join(first_seen_by_site(documents), ["domain", "port"], "left")


def bar_chart(rows: DataFrame, label: str, n: str, width: int = 40) -> DataFrame:
    most = rows.agg(F.max(n).alias("_most"))
    bars = F.expr(f"repeat('█', cast(round({width} * `{n}` / _most) as int))")
    return rows.join(F.broadcast(most)).withColumn("bar", F.concat(F.rpad(label, 20, " "), bars)).drop("_most")  # one row


def year_heading(day: Column, w) -> Column:
    return F.coalesce(F.year(F.lag(day).over(w)) != F.year(day), F.lit(True))
