"""Steps of a crawl as dataflow: what is stored, which entries come next, why some are skipped, and loops to a fixpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.urls import is_special
from driftline.operators import rules
from driftline.shared import folder

from .archive import MOST_STORED

#: Fixed value: how many URLs a crawl asks for at most.
MOST_URLS = 5_000_000


def stored(responses: DataFrame, most: int = MOST_STORED) -> DataFrame:
    """Text and images whole, other bodies cut to ``most`` bytes and flagged."""
    whole = F.col("mime_type").startswith("text/") | F.col("mime_type").startswith("image/")
    cut = ~F.coalesce(whole, F.lit(False)) & (F.octet_length("body") > most)
    cut = F.coalesce(cut, F.lit(False))
    return responses.withColumn("is_body_truncated", F.col("is_body_truncated") | cut).withColumn("body", F.when(cut, F.substring("body", 1, most)).otherwise(F.col("body")))


def next_entries(frontier: DataFrame, per_site: int = 1, most: int = MOST_URLS) -> DataFrame:
    """Each site's entries of least priority, as many as are asked for at a time."""
    n = F.row_number().over(Window.partitionBy("authority").orderBy("priority", "seq"))
    return frontier.withColumn("_n", n).where(F.col("_n") <= per_site).orderBy("priority", "seq").drop("_n").limit(most)


def by_worker(entries: DataFrame, workers: int) -> DataFrame:
    """A site's entries all go to one worker; the same one in every run."""
    return entries.withColumn("worker", F.pmod(F.crc32(F.col("authority").cast("string")), F.lit(workers)).cast("int"))


def outcome(down: Column, allowed: Column) -> Column:
    """Why an entry is skipped: connectivity comes first, then robots."""
    return F.when(down, "connectivity").when(~allowed, "robots").otherwise("none")


def retried(log: DataFrame, slow_down: int = 44, most: int = 5) -> DataFrame:
    """Requests that are asked again: slow-down answers, up to a number of times each."""
    n = F.count_if(F.col("status_code") == slow_down).over(Window.partitionBy("authority", "url").orderBy("seq"))
    return log.withColumn("retry", (F.col("status_code") == slow_down) & (n <= most))


def followed(responses: DataFrame) -> DataFrame:
    """Responses whose links are followed: a body not seen before, and no file that was asked for unasked."""
    return rules.content_seen(responses.where(~F.col("is_proactive")), "data_hash", "seq").where("not seen").drop("seen")


def fixpoint(start: DataFrame, step, key: str) -> DataFrame:
    """All that is reached from ``start`` by ``step`` (DataFrame of new rows -> DataFrame of found rows), each key once.
    It ends when a round finds no new key, however many rounds that takes. Rounds are Parquet in the shared folder, so plans
    stay as small as a round's."""
    spark = start.sparkSession
    place = folder(spark, "fixpoint")

    def written(rows: DataFrame, n: int) -> DataFrame:
        rows.write.parquet(f"{place}/r{n}")
        return spark.read.schema(start.schema).parquet(f"{place}/r{n}")

    n, fresh = 0, written(start.dropDuplicates([key]), 0)
    while not fresh.isEmpty():
        done = spark.read.schema(start.schema).parquet(f"{place}/r*").select(F.col(key).alias("_done"))
        # a null key is found once like others
        found = step(fresh).select(start.columns).dropDuplicates([key])
        n, fresh = n + 1, written(found.join(done, F.col(key).eqNullSafe(F.col("_done")), "left_anti"), n + 1)
    return spark.read.schema(start.schema).parquet(f"{place}/r*")


def image_terms(images: DataFrame, link_texts: DataFrame, words_of_path: Column) -> DataFrame:
    """Terms of images that links describe: the links' texts and the words of the path; others have no entry."""
    return images.join(link_texts, F.col("url_id") == F.col("target_url_id")).select("url_id", F.concat_ws(" ", "texts", F.array_join(words_of_path, " ")).alias("terms"))


def image_side(documents: DataFrame) -> DataFrame:
    """The image table that follows from the latest documents: those that are images now."""
    return documents.where(F.col("image").isNotNull() & F.col("status_code").between(20, 29)).select("url_id", "image.*")


def with_images(documents: DataFrame, images: DataFrame) -> DataFrame:
    side = images.select(F.col("url_id"), F.struct(*[c for c in images.columns if c != "url_id"]).alias("image"))
    return documents.join(side, "url_id", "left")


def with_snapshots(urls: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each URL with its captures in order; for pages of one URL's history."""
    own = snapshots.groupBy("url_id").agg(F.sort_array(F.collect_list(F.struct("captured", "seq", "data_hash"))).alias("snapshots"))
    return urls.join(own, "url_id", "left")


def diff_navigation(snapshots: DataFrame) -> DataFrame:
    """For each pair of neighbouring versions, the pair before and the pair after."""
    w = Window.partitionBy("url_id").orderBy("captured", "seq")
    t = lambda n: F.lag("captured", n).over(w) if n >= 0 else F.lead("captured", -n).over(w)
    df = snapshots.select("url_id", "seq", "captured", t(1).alias("old"), t(2).alias("before_old"), t(-1).alias("after"))
    return df.where("old is not null")


def pack_size(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.count("*").alias("blobs"), F.sum(F.octet_length("body")).alias("bytes"))


def payload_fixed(records: DataFrame) -> DataFrame:
    """Payload type and digest filled in where they are missing."""
    digest = F.concat(F.lit("sha256:"), F.sha2("block", 256))
    return records.withColumn("content_type", F.coalesce("content_type", F.lit("application/octet-stream"))).withColumn("payload_digest", F.coalesce(F.col("headers")["warc-payload-digest"], digest))


def admitted(responses: DataFrame, block_rules: DataFrame) -> DataFrame:
    """Responses that are taken in: no block rule holds for their URL (url, authority); files that crawlers ask for without a
    link are taken whatever the rules say."""
    judged = rules.blocked_by(responses, block_rules)
    return judged.where(F.col("blocked_by").isNull() | is_special(F.col("url"))).drop("blocked_by")
