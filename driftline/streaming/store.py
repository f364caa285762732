"""The tables that a crawl's responses keep, taken batch by batch, each batch as one commit.

A table is a row of parts, one per batch: its rows, and the keys that they replace or remove, which hide older parts' rows of
those keys. So a batch rewrites nothing, and reads of older parts what its own keys have. Parts count once the batch's row in
``manifest`` names them: a batch that was stopped between two tables is nowhere seen, and the stream gives it again; one that
was committed and comes again is left out by its number. Of two writers at once the later one fails.

Tables, by key: ``documents`` (url_id), ``links`` (source_url_id: a page's links are replaced as a whole), ``images`` (url_id),
``special_files`` (site and path) and ``work`` (url_id: what is to be done again, until ``done`` takes it off).

Responses have url_id, seq, received, status_code, response_hash, is_text, and of their site and body protocol, domain, port, path,
is_proactive, content (of special files), links (target_url_id, is_external, link_text, in order) and image (width, height,
image_type, is_transparent; null if there is none). Rows with a null url_id are left out; null links are none.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.urls import FAVICON, ROBOTS, SECURITY
from driftline.operators import documents
from driftline.operators.rules import robots_valid

_IMAGE = "width int, height int, image_type string, is_transparent boolean"
SCHEMAS = {
    "documents": "url_id bigint, first_seen timestamp, last_visit timestamp, last_successful_visit timestamp, last_time_updated timestamp, status_code int, response_hash string, seq bigint, action string, is_new boolean, is_changed boolean",
    "links": "source_url_id bigint, target_url_id bigint, is_external boolean, link_text string",
    "images": f"url_id bigint, {_IMAGE}",
    "special_files": "protocol string, domain string, port int, path string, content string, source_url_id bigint, received timestamp, valid boolean",
    "work": "url_id bigint, work_types int",
}
KEYS = {"documents": ["url_id"], "links": ["source_url_id"], "images": ["url_id"], "special_files": ["protocol", "domain", "port", "path"], "work": ["url_id"]}
_MANIFEST = "version bigint, parts string, taken string"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    version: int = -1
    #: Names of the batches' parts, oldest first, and the tables that each has hidden keys of.
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    taken: dict[str, int] = field(default_factory=dict)

    def _rows(self, what: str, table: str, schema: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], f"{schema}, _order int")
        base = f"{self.path}/{what}/{table}"
        orders = F.create_map(*[F.lit(x) for n, (p, _) in enumerate(self.parts) for x in (p, n)])
        rows = self.spark.read.schema(f"{schema}, part string").option("basePath", base).parquet(*[f"{base}/part={p}" for p in parts])
        return rows.withColumn("_order", F.element_at(orders, F.col("part"))).drop("part")

    def table(self, name: str) -> DataFrame:
        """The rows that no later batch has replaced or removed."""
        rows = self._rows("rows", name, SCHEMAS[name], [p for p, _ in self.parts])
        hiding = [p for p, tables in self.parts if name in tables]
        if not hiding:
            return rows.drop("_order")
        schema = ", ".join(c for c in SCHEMAS[name].split(", ") if c.split()[0] in KEYS[name])
        hidden = self._rows("hidden", name, schema, hiding).groupBy(*KEYS[name]).agg(F.max("_order").alias("_below"))
        met = rows.join(hidden, KEYS[name], "left").where(F.col("_below").isNull() | (F.col("_order") >= F.col("_below")))
        return met.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")])

    def work(self) -> DataFrame:
        """What is to be done, a row per URL."""
        return documents.merged_work(self.table("work"))

    def special_files(self) -> DataFrame:
        return self.table("special_files").where("valid").drop("valid")


def opened(spark: SparkSession, path: str) -> Store:
    """The latest version of the store under ``path``; an empty one where there is none."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not where.getFileSystem(jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()).exists(where):
        return Store(spark, path)
    row = spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).json(f"{path}/manifest").orderBy(F.desc("version")).first()
    return Store(spark, path, row["version"], tuple((p, tuple(t)) for p, t in json.loads(row["parts"])), json.loads(row["taken"]))


def _commit(store: Store) -> Store:
    row = {"version": store.version, "parts": json.dumps(store.parts), "taken": json.dumps(store.taken)}
    store.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("error").json(f"{store.path}/manifest/{store.version:012d}")
    return store


class _Batch:
    """The parts of one batch while they are written."""

    def __init__(self, store: Store):
        self.store, self.part, self.hiding = store, uuid.uuid4().hex, []

    def _written(self, what: str, table: str, rows: DataFrame) -> DataFrame:
        place = f"{self.store.path}/{what}/{table}/part={self.part}"
        rows.write.mode("overwrite").parquet(place)
        return self.store.spark.read.schema(rows.schema).parquet(place)

    def rows(self, table: str, rows: DataFrame) -> DataFrame:
        names = [c.split() for c in SCHEMAS[table].split(", ")]
        return self._written("rows", table, rows.select(*[F.col(n).cast(t).alias(n) for n, t in names]))

    def hides(self, table: str, keys: DataFrame) -> None:
        self._written("hidden", table, keys.select(*KEYS[table]))
        self.hiding.append(table)

    def commit(self, source: str, number: int | None) -> Store:
        s = self.store
        taken = s.taken if number is None else {**s.taken, source: number}
        return _commit(Store(s.spark, s.path, s.version + 1, (*s.parts, (self.part, tuple(self.hiding))), taken))


def _valid(files: DataFrame) -> DataFrame:
    """Special files with whether they count: robots files with a rule, security files with a contact, any favicon."""
    ruled = robots_valid(files.where(F.col("path") == ROBOTS).select(F.struct(*KEYS["special_files"]).alias("authority"), "content").withColumn("authority", F.to_json("authority")))
    ruled = ruled.select(F.col("authority").alias("_key"), F.col("valid").alias("_ruled"))
    met = files.withColumn("_key", F.to_json(F.struct(*KEYS["special_files"]))).join(ruled, "_key", "left")
    ok = F.col("status_code").between(20, 29) & F.col("content").isNotNull()
    own = F.when(F.col("path") == ROBOTS, F.col("_ruled")).when(F.col("path") == SECURITY, documents.valid_security_contact(F.col("content"))).otherwise(F.col("path") == FAVICON)
    return met.withColumn("valid", F.coalesce(ok & own, F.lit(False))).drop("_key", "_ruled")


def take(store: Store, responses: DataFrame, source: str = "", number: int | None = None) -> Store:
    """The store after a batch of responses; see the module. A batch that was taken before changes nothing."""
    if number is not None and store.taken.get(source, -1) >= number:
        return store
    batch, rows = _Batch(store), responses.where("url_id is not null")
    ids = rows.select("url_id").distinct()
    known = store.table("documents").join(ids, "url_id", "left_semi")
    before = known.select("url_id", F.col("seq").alias("_seq"), F.col("status_code").between(20, 29).alias("_available"))
    after = documents.fold(rows, known).join(before, "url_id", "left")
    now_available = F.col("status_code").between(20, 29)
    new = F.col("_seq").isNull() | (~F.col("_available") & now_available)
    docs = batch.rows("documents", after.withColumns({"is_new": new, "is_changed": F.col("_seq").isNull() | (F.col("seq") != F.col("_seq"))}))
    batch.hides("documents", docs)
    # the responses whose content counts now
    changed = docs.where("is_changed").select("url_id", "seq")
    content = rows.join(changed, ["url_id", "seq"]).dropDuplicates(["url_id"])
    image = content.where(F.col("image").isNotNull() & F.col("status_code").between(20, 29)).select("url_id", "image.*")
    images = batch.rows("images", image)
    batch.hides("images", changed)
    ordered = content.select(F.col("url_id").alias("source_url_id"), F.posexplode("links").alias("n", "l")).select("source_url_id", "n", "l.*")
    links = batch.rows("links", documents.one_link_per_target(ordered, "n"))
    sources = changed.select(F.col("url_id").alias("source_url_id"))
    batch.hides("links", sources)
    told = documents.link_changes(store.table("links").join(sources, "source_url_id", "left_semi"), links)
    # of special files the latest of a site, also when its content is the same
    special = rows.where("is_proactive").groupBy(*KEYS["special_files"]).agg(F.max_by(F.struct("content", F.col("url_id").alias("source_url_id"), "status_code", "received"), F.struct("received", "seq")).alias("_r")).select(*KEYS["special_files"], "_r.*")
    held = store.table("special_files").select(*KEYS["special_files"], F.col("received").alias("_held"))
    special = batch.rows("special_files", _valid(special.join(held, KEYS["special_files"], "left").where("_held is null or received >= _held").drop("_held")))
    batch.hides("special_files", special)
    proactive = rows.groupBy("url_id").agg(F.bool_or("is_proactive").alias("is_proactive"))
    fresh = docs.where("is_new").join(proactive, "url_id").join(images.select("url_id", F.lit(True).alias("_image")), "url_id", "left")
    fresh = documents.dirty(fresh.withColumns({"is_image": F.coalesce("_image", F.lit(False)), "is_body_indexed": F.col("action").isin("AddCurrent", "RefreshWithCurrent")}))
    batch.rows("work", documents.merged_work(fresh, told.where("work > 0").select(F.col("target_url_id").alias("url_id"), F.col("work").alias("work_types"))))
    return batch.commit(source, number)


def done(store: Store, ids: DataFrame) -> Store:
    """The store with the work on ``ids`` (url_id) taken off."""
    batch = _Batch(store)
    for name in SCHEMAS:
        batch.rows(name, store.spark.createDataFrame([], SCHEMAS[name]))
    batch.hides("work", ids)
    return batch.commit("", None)


def taking(path: str, source: str = "crawl"):
    """For foreachBatch: takes each batch of responses into the store under ``path``, once."""

    def put(batch: DataFrame, number: int) -> None:
        take(opened(batch.sparkSession, path), batch, source, number)

    return put
