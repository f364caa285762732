"""Snapshot history: content dedup, nearest and neighbouring captures, history and statistics.

Flags need order: ``seq`` is the order of ingestion, ``captured`` the time of capture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sizes up to which bodies are kept.
MOST_ARCHIVED, MOST_STORED = 5 << 20, 10 << 10


def storable(responses: DataFrame) -> DataFrame:
    """Success with a body, or input, redirect and certificate answers; large or cut bodies only if text."""
    status, text = F.col("status_code"), F.col("mime_type").startswith("text/")
    fits = status.between(20, 29) & (F.col("size") > 0) & (text | ((F.col("size") <= MOST_ARCHIVED) & ~F.col("is_body_truncated")))
    return responses.where(fits | status.between(10, 19) | status.between(30, 39) | status.between(60, 69))


def truncated(responses: DataFrame, most: int = MOST_ARCHIVED) -> DataFrame:
    """Bodies cut to ``most`` bytes, with the flag set where something was cut."""
    long = F.octet_length("body") > most
    return responses.withColumn("is_body_truncated", F.col("is_body_truncated") | F.coalesce(long, F.lit(False))).withColumn("body", F.when(long, F.substring("body", 1, most)).otherwise(F.col("body")))


def new_captures(captures: DataFrame, stored: DataFrame) -> DataFrame:
    """Captures not stored yet, each (url_id, captured) once."""
    keys = ["url_id", "captured"]
    return captures.join(stored.select(keys), keys, "left_anti").dropDuplicates(keys)


def dedup_flags(snapshots: DataFrame) -> DataFrame:
    """is_duplicate (an earlier one of the same URL and hash), is_global_duplicate (an earlier one of the same hash and
    another URL), first_seq (whose blob is reused).

    Of a hash's rows only three facts matter: the first URL, its place, and the first place where another one came in.
    They come from aggregates, which are made per task before rows move, and are joined back; so a hash that a third of
    all rows have (an empty body) is no window in one task, and its rows can be split over tasks in the join.
    """
    h = F.col("data_hash").eqNullSafe(F.col("_h"))
    of_url = snapshots.groupBy(F.col("data_hash").alias("_h"), F.col("url_id").alias("_u")).agg(F.min("seq").alias("_own"))
    first = of_url.groupBy("_h").agg(F.min_by("_u", "_own").alias("_first"), F.min("_own").alias("first_seq"))
    other = of_url.join(first.select(F.col("_h").alias("_h2"), "_first"), F.col("_h").eqNullSafe(F.col("_h2"))).where(~F.col("_u").eqNullSafe(F.col("_first"))).groupBy("_h").agg(F.min("_own").alias("_other"))
    facts = first.join(other.withColumnRenamed("_h", "_h3"), F.col("_h").eqNullSafe(F.col("_h3")), "left").drop("_h3")
    df = snapshots.join(of_url, h & F.col("url_id").eqNullSafe(F.col("_u"))).drop("_h", "_u").join(facts, h).drop("_h")
    return df.select(
        *snapshots.columns,
        (F.col("seq") > F.col("_own")).alias("is_duplicate"),
        (~F.col("url_id").eqNullSafe(F.col("_first")) | F.coalesce(F.col("_other") < F.col("seq"), F.lit(False))).alias("is_global_duplicate"),
        "first_seq",
    )


def latest(snapshots: DataFrame, key: str = "url_id") -> DataFrame:
    rest = [c for c in snapshots.columns if c != key]
    return snapshots.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("captured", "seq")).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def nearest(snapshots: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (url_id, at) of ``wanted`` the snapshot captured nearest; of two as near, the earlier.

    As-of both ways without joining all pairs: both sides are sorted together once per URL, each wanted time looks at
    the last capture before and the first after.
    """
    side = snapshots.select("url_id", F.col("captured").alias("_t"), F.struct("captured", "seq").alias("_s"), F.lit(0).alias("_ask"))
    ask = wanted.select("url_id", F.col("at").alias("_t"), F.lit(None).cast(side.schema["_s"].dataType).alias("_s"), F.lit(1).alias("_ask"))
    w = Window.partitionBy("url_id").orderBy("_t", "_ask")
    before = F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = side.unionByName(ask).withColumn("_b", before).withColumn("_a", after).where("_ask = 1")
    gap = lambda s: F.abs(F.unix_micros(F.col(f"{s}.captured")) - F.unix_micros("_t"))
    pick = F.when(F.col("_a").isNull() | (gap("_b") <= gap("_a")), F.col("_b")).otherwise(F.col("_a"))
    return both.withColumn("_p", pick).where("_p is not null").select("url_id", F.col("_t").alias("at"), "_p.captured", "_p.seq")


def neighbours(snapshots: DataFrame) -> DataFrame:
    """Each snapshot that isn't a duplicate with the one before and after it, and whether its year is a new heading."""
    w = Window.partitionBy("url_id").orderBy("captured", "seq")
    own = snapshots.where("not is_duplicate")
    return own.withColumn("previous", F.lag("captured").over(w)).withColumn("next", F.lead("captured").over(w)).withColumn("new_year", F.coalesce(F.year(F.lag("captured").over(w)) != F.year("captured"), F.lit(True)))


def history(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("url_id").agg(F.count("*").alias("captures"), F.min("captured").alias("first_capture"), F.max("captured").alias("last_capture"), F.countDistinct("data_hash").alias("versions"), F.count_if("is_body_truncated").alias("truncated"))


def statistics(urls: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: URLs public and excluded, captures, unique captures, sizes, and the time covered."""
    unique = ~F.col("is_duplicate") & ~F.col("is_global_duplicate")
    of_urls = urls.agg(F.count_if("is_public").alias("urls_public"), F.count_if(~F.col("is_public")).alias("urls_excluded"), F.countDistinct("domain", "port").alias("domains"))
    of_snapshots = snapshots.agg(F.count("*").alias("captures"), F.count_if(unique).alias("captures_unique"), F.sum("size").alias("size"), F.sum(F.when(unique, F.col("size"))).alias("size_unique"), F.min("captured").alias("oldest"), F.max("captured").alias("newest"))
    return of_urls.join(of_snapshots).withColumn("urls_total", F.col("urls_public") + F.col("urls_excluded"))  # one row each


def url_search(urls: DataFrame, text: str, most: int = 100) -> DataFrame:
    """Public URLs that hold ``text``: where it stands early first, then short ones, then by name."""
    at = F.instr("full_url", text)
    return urls.where(F.col("is_public") & (at > 0)).withColumn("at", at).orderBy("at", F.length("full_url"), "full_url").limit(most)


def visibility(urls: DataFrame, snapshots: DataFrame, rules: DataFrame, agent: str = "archiver") -> DataFrame:
    """is_public anew for sites with rules; sites without keep it."""
    from .rules import robots_allowed

    touched = rules.select("authority").distinct().withColumn("_ruled", F.lit(True))
    judged = robots_allowed(urls, rules, agent).join(touched, "authority", "left")
    return judged.withColumn("is_public", F.when(F.col("_ruled"), F.col("allowed")).otherwise(F.col("is_public"))).drop("_ruled", "allowed")


def blobs(snapshots: DataFrame) -> DataFrame:
    """Each body once, under its hash's first two digits: a content-addressed store as a partitioned table."""
    return snapshots.groupBy("data_hash").agg(F.any_value("body").alias("body")).withColumn("prefix", F.substring(F.regexp_replace("data_hash", "^[^:]*:", ""), 1, 2))


def version_pairs(snapshots: DataFrame) -> DataFrame:
    """Each version of a URL (url_id, captured, seq, text) with the text of the one before, ``old``; the first has none and is left
    out."""
    w = Window.partitionBy("url_id").orderBy("captured", "seq")
    return snapshots.withColumn("old", F.lag("text").over(w)).withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def versions_diff(snapshots: DataFrame) -> DataFrame:
    """Line by line what changed from each version of a URL to the next."""
    from driftline.functions.text import line_diff

    return version_pairs(snapshots).withColumn("c", F.explode(line_diff("old", "text"))).select("url_id", "captured", "c.position", "c.change", "c.line")
