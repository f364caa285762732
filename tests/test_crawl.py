from driftline.functions import formats
from driftline.operators import crawl
from pyspark.sql import functions as F


def test_stored_bodies(spark):
    rows = [("text/x", b"abcdef"), ("image/x", b"abcdef"), ("application/x", b"abcdef"), ("application/x", b"ab"), (None, b"abcdef"), ("text/x", None)]
    df = spark.createDataFrame([(m, None if b is None else bytearray(b), False) for m, b in rows], "mime_type string, body binary, is_body_truncated boolean")
    got = [(None if r.body is None else bytes(r.body), r.is_body_truncated) for r in crawl.stored(df, 4).collect()]
    assert got == [(b"abcdef", False), (b"abcdef", False), (b"abcd", True), (b"ab", False), (b"abcd", True), (None, False)]


def test_workers_and_outcomes(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "authority string")
    assert {(r.authority, r.worker) for r in crawl.by_worker(df, 4).collect()} == {(r.authority, r.worker) for r in crawl.by_worker(df.distinct(), 4).collect()}
    got = spark.createDataFrame([(True, False), (False, False), (False, True)], "down boolean, ok boolean").select(crawl.outcome(F.col("down"), F.col("ok")).alias("o")).collect()
    assert [r.o for r in got] == ["connectivity", "robots", "none"]


def test_images(spark):
    docs = spark.createDataFrame([(1, 20, (3, 4)), (2, 51, (3, 4)), (3, 20, None)], "url_id long, status_code int, image struct<width:int,height:int>")
    side = crawl.image_side(docs)
    assert [tuple(r) for r in side.collect()] == [(1, 3, 4)]
    assert {r.url_id: r.image is not None for r in crawl.with_images(docs.drop("image"), side).collect()} == {1: True, 2: False, 3: False}
    texts = spark.createDataFrame([(1, "a cat")], "target_url_id long, texts string")
    assert [tuple(r) for r in crawl.image_terms(docs, texts, F.array(F.lit("pics"))).collect()] == [(1, "a cat pics")]


def test_small_formats(spark):
    df = spark.createDataFrame([("/a/b%20c.gmi", "https://web.archive.org/web/20210203040506id_/https://proxy.example/gemini/host.example/some/long/path")], "p string, w string")
    r = df.select(formats.filename_shown(F.col("p")).alias("f"), formats.wayback_wanted(F.col("w")).alias("w"), formats.proxied_url(formats.wayback_source(F.col("w"))).alias("g"), formats.is_domain_name(F.lit("a-b.example.org")).alias("d"), formats.is_domain_name(F.lit("-a.b")).alias("e"), formats.gemtext_row(F.lit("/x"), F.lit("a\nb")).alias("row"), formats.wayback_capture(F.lit("2021"), F.lit("u")).alias("c")).first()
    assert tuple(r) == ("b c.gmi", True, "gemini://host.example/some/long/path", True, False, "=> /x ab", "https://web.archive.org/web/2021id_/u")


def test_fixpoint_of_a_long_chain(spark):
    def step(new):
        # the last page leads to nowhere: a null link
        return new.select(F.when(F.col("node") < 104, F.col("node") + 1).alias("node"))

    got = crawl.fixpoint(spark.createDataFrame([(0,)], "node bigint"), step, "node")
    assert sorted(-1 if r.node is None else r.node for r in got.collect()) == list(range(-1, 105))
    assert crawl.fixpoint(got.limit(0), step, "node").count() == 0
