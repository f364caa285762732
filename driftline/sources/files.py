"""Other inputs and outputs: crawl logs, CDX, JSON, seed lists, statistics, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import formats, urls
from driftline.operators import reports


def _fields(spark: SparkSession, path: str, sep: str) -> tuple[DataFrame, Column]:
    return spark.read.text(path), F.split("value", sep)


def crawl_log_a(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated, empty fields don't count, at least four; the second starts with 20."""
    lines, parts = _fields(spark, path, "\t")
    f = F.filter(parts, lambda x: x != "")
    return lines.select(f.alias("f")).where((F.size("f") >= 4) & F.col("f")[1].startswith("20 ")).select(F.col("f")[0].alias("received"), F.substring(F.col("f")[1], 4, 1 << 30).alias("meta"), F.col("f")[2].alias("url"), F.col("f")[3].alias("body_name"))


def crawl_log_b(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated status, meta, url of successes; without a fourth field the body is missing, so it was cut."""
    lines, f = _fields(spark, path, "\t")
    return lines.select(f.alias("f")).where((F.size("f") >= 3) & (F.col("f")[0] == "20")).select(F.col("f")[0].cast("int").alias("status_code"), F.col("f")[1].alias("meta"), F.col("f")[2].alias("url"), (F.size("f") < 4).alias("is_body_truncated"))


def crawl_log_c(spark: SparkSession, path: str, blobs: DataFrame) -> DataFrame:
    """As b, with a body by its hash where a line has just nine fields."""
    lines, f = _fields(spark, path, "\t")
    rows = lines.select(f.alias("f")).where((F.size("f") >= 3) & (F.col("f")[0] == "20")).select(F.col("f")[0].cast("int").alias("status_code"), F.col("f")[1].alias("meta"), F.col("f")[2].alias("url"), F.when(F.size("f") == 9, F.element_at("f", 9)).alias("data_hash"))
    return rows.join(blobs.select("data_hash", "body"), "data_hash", "left").withColumn("is_body_truncated", F.col("body").isNull())


def cdx(spark: SparkSession, path: str) -> DataFrame:
    """Seven fields between spaces: captures with a 2xx or 3xx status."""
    lines, f = _fields(spark, path, " ")
    rows = lines.select(f.alias("f")).where((F.size("f") == 7) & F.col("f")[4].rlike(r"^[23]\d\d$"))
    return rows.select(F.try_to_timestamp(F.col("f")[1], F.lit("yyyyMMddHHmmss")).alias("captured"), F.col("f")[2].alias("url"), F.col("f")[3].alias("content_type"), F.col("f")[4].cast("int").alias("status_code"))


def json_table(text: Column) -> Column:
    """Rows of a JSON array of arrays, without its first, the header."""
    rows = F.from_json(text, "array<array<string>>")
    return F.when(F.size(rows) > 1, F.slice(rows, 2, F.size(rows) - 1)).otherwise(F.array().cast("array<array<string>>"))


def encyclopedia_hits(text: Column) -> Column:
    """array<struct<title, description>> of a search answer."""
    pages = F.from_json(text, "struct<pages:array<struct<title:string,description:string>>>")["pages"]
    return F.coalesce(pages, F.array().cast("array<struct<title:string,description:string>>"))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """line_no and line; rule files and seed lists, which are small, so one task may number them."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    from driftline.functions.urls import normalized

    return lines_of(spark, path).where(F.trim("line").rlike(r"^[a-z]+://[^/]+")).select(normalized(F.trim("line")).alias("url")).distinct()


def object_key(id_: Column) -> Column:
    """Where a stored body lies: two levels of two digits of the id's MD5, then the whole."""
    # the id's bytes, the lowest first
    pairs = F.regexp_extract_all(F.lpad(F.hex(id_), 16, "0"), F.lit(".."), F.lit(0))
    digest = F.md5(F.unhex(F.array_join(F.reverse(pairs), "")))
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def with_bodies(rows: DataFrame, objects: DataFrame) -> DataFrame:
    return rows.withColumn("key", object_key(F.col("url_id"))).join(objects, "key", "left")


def write_statistics(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def write_log(rows: DataFrame, path: str) -> None:
    """Tab-separated, with tabs and newlines in values made spaces."""
    clean = [F.translate(F.col(c).cast("string"), "\t\r\n", "   ").alias(c) for c in rows.columns]
    rows.select(*clean).write.mode("overwrite").csv(path, sep="\t")


def write_mime_csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_blobs(blobs: DataFrame, path: str) -> None:
    """Bodies by the first two digits of their hash, compressed."""
    blobs.write.mode("append").partitionBy("prefix").option("compression", "zstd").parquet(path)


def crawl_database(documents: DataFrame, objects: DataFrame, domains: DataFrame) -> DataFrame:
    """Captures of an older crawl's tables: documents (url_id, url, first_seen, status_code, meta, mime_type, connect_failed), their
    bodies in an object store (key, body), and what its domains (domain, port, is_reachable and the texts of special files) keep.
    Rows with a URL that isn't one, or a line break in a success's meta, are left out; status and meta are as they are
    written now; a success without a body counts as cut, as does one whose fetch was given up for its size."""
    status, meta = formats.legacy_status(F.col("status_code"), F.col("meta"))
    given_up = F.col("meta").startswith("Requestor aborting due to reaching max download")
    ok = status.between(20, 29)
    failed = ok & F.col("connect_failed") & ~given_up
    kept = documents.where(F.col("url").rlike(r"^[a-z]+://[^/?#:]+(:[0-9]{1,5})?([/?#]|$)") & ~(F.col("status_code").between(20, 29) & F.col("meta").contains("\n")))
    rows = kept.select("url_id", "url", F.col("first_seen").alias("received"), F.when(failed, 49).otherwise(status).alias("status_code"), F.when(ok & given_up, F.col("mime_type")).otherwise(meta).alias("meta"), "mime_type", (ok & given_up).alias("_given_up"))
    ok = F.col("status_code").between(20, 29)
    found = with_bodies(rows, objects).withColumn("mime_type", F.when(ok, F.lower(F.trim(F.substring_index("mime_type", ";", 1)))).otherwise(""))
    found = found.withColumn("is_body_truncated", F.coalesce(F.col("_given_up") | (ok & F.col("body").isNull()), F.lit(False))).drop("key", "_given_up", "url_id")
    special = reports.special_captures(domains, documents.select(*[urls_of(F.col("url")).alias(c) for c, urls_of in (("domain", urls.domain), ("port", urls.port))], "first_seen"))
    address = F.concat(F.lit("gemini://"), "domain", F.when(F.col("port") == urls.DEFAULT_PORT, "").otherwise(F.concat(F.lit(":"), "port")), "path")
    texts = special.select(address.alias("url"), F.col("first_seen").alias("received"), F.lit(20).alias("status_code"), F.lit("text/plain").alias("meta"), F.lit("text/plain").alias("mime_type"), F.encode("content", "UTF-8").alias("body"), F.lit(False).alias("is_body_truncated"))
    return found.select(texts.columns).unionByName(texts)
