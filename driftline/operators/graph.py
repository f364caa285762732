"""The link graph: popularity, anchor texts, inbound, outbound and cross-site links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def popularity_rank(inbound: Column, available: Column) -> Column:
    """log to base 100 of external inbound links plus one, at most 1; 0 for what can't be reached."""
    return F.when(available, F.log(100.0, F.least(F.lit(100.0), inbound + F.lit(1.0)))).otherwise(0.0)


def popularity(documents: DataFrame, links: DataFrame) -> DataFrame:
    inbound = links.where("is_external").groupBy("target_url_id").agg(F.count("*").alias("_n"))
    joined = documents.join(inbound, F.col("url_id") == F.col("target_url_id"), "left")
    n = F.coalesce("_n", F.lit(0))
    return joined.select("url_id", n.alias("external_inbound_links"), popularity_rank(n, F.col("is_available")).alias("popularity_rank"))


def link_texts(links: DataFrame) -> DataFrame:
    return links.where(F.coalesce("link_text", F.lit("")) != "").groupBy("target_url_id").agg(F.array_join(F.array_sort(F.collect_set("link_text")), " ").alias("texts"))


def inbound(links: DataFrame, documents: DataFrame, external: bool) -> DataFrame:
    flag = F.col("is_external") if external else ~F.col("is_external")
    return links.where(flag).join(documents, F.col("source_url_id") == F.col("url_id")).select("target_url_id", "source_url_id", "url", "title", "link_text")


def outbound(links: DataFrame, documents: DataFrame) -> DataFrame:
    return links.join(documents, F.col("target_url_id") == F.col("url_id")).select("source_url_id", "target_url_id", "url", "title", "link_text", "is_external")


def backlinks(links: DataFrame, sources: DataFrame, targets: DataFrame, domain: str) -> DataFrame:
    """External links into a domain with group and place numbers and the run's length, by target. Groups are numbered
    over one domain's pages that have links."""
    source, target = sources.alias("s"), targets.where(F.col("domain") == domain).alias("t")
    rows = links.where("is_external").join(target, F.col("target_url_id") == F.col("t.url_id")).join(source, F.col("source_url_id") == F.col("s.url_id"))
    out = rows.select(F.col("t.url").alias("target_url"), F.col("s.url").alias("source_url"), "link_text")
    w = Window.partitionBy("target_url").orderBy("source_url", "link_text")
    numbered = out.withColumn("place", F.row_number().over(w)).withColumn("links", F.count("*").over(Window.partitionBy("target_url")))
    groups = out.select("target_url").distinct().withColumn("group_no", F.row_number().over(Window.orderBy("target_url")))
    return numbered.join(groups, "target_url")


def interactive(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Pages that ask for input, and their pages' internal links to them."""
    asks = documents.where("status_code between 10 and 19").select(F.col("url_id").alias("_t"), F.col("url").alias("input_url"))
    return links.where("not is_external").join(asks, F.col("target_url_id") == F.col("_t")).select("input_url", "source_url_id").distinct()
