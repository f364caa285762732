import random
from datetime import datetime, timedelta

import pytest
from driftline.operators import documents
from driftline.streaming import store
from pyspark.sql import functions as F

T0 = datetime(2023, 1, 1)
SCHEMA = (
    "url_id long, seq long, received timestamp, status_code int, response_hash string, is_text boolean, protocol string, domain string, port int, path string, is_proactive boolean, content string, "
    "links array<struct<target_url_id:long,is_external:boolean,link_text:string>>, image struct<width:int,height:int,image_type:string,is_transparent:boolean>"
)


def responses(n=120):
    rnd = random.Random(12)
    rows = []
    for seq in range(n):
        url, status, version = rnd.randrange(12), rnd.choice([20, 20, 20, 51]), rnd.randrange(3)
        ok, path = status == 20, {0: "/robots.txt", 1: "/favicon.txt", 2: "/.well-known/security.txt"}.get(url, f"/{url}")
        content = {0: ["User-agent: *\nDisallow: /x", "none", None][version], 1: "E", 2: ["Contact: a", "no", None][version]}.get(url)
        links = [(rnd.randrange(12), k == 1, f"t{version}") for k in range(3)] if ok and url > 4 else None
        if links and version == 2:
            links = [*links, (links[0][0], True, "again")]
        rows.append((url, seq, T0 + timedelta(hours=rnd.randrange(n)), status, f"h{version}" if ok else "bad", ok and url != 4, "gemini", "h", 1965, path, url < 3, content, links, (version, 2, "PNG", False) if ok and url == 4 and version else None))
    return rows


@pytest.fixture(scope="module")
def taken(spark, tmp_path_factory):
    """All responses in five batches, with one that is stopped between tables, and one that comes again."""
    path, rows = f"file://{tmp_path_factory.mktemp('store')}", responses()
    cuts, real = [0, 1, 30, 31, 90, 120], store._Batch.rows
    for n in range(5):
        batch = spark.createDataFrame(rows[cuts[n] : cuts[n + 1]], SCHEMA)
        if n in (2, 4):
            before = store.opened(spark, path)
            for table in ("images", "work"):

                def stopped(self, name, df, table=table):
                    if name == table:
                        raise RuntimeError("lost")
                    return real(self, name, df)

                store._Batch.rows = stopped
                try:
                    with pytest.raises(RuntimeError):
                        store.take(before, batch, "crawl", n)
                finally:
                    store._Batch.rows = real
                assert store.opened(spark, path) == before
        store.taking(path)(batch, n)
        if n == 3:
            again = store.opened(spark, path)
            store.taking(path)(batch, n)
            assert store.opened(spark, path) == again
    return store.opened(spark, path), rows


def test_documents_as_in_one_batch(spark, taken):
    held, rows = taken
    names = ["url_id", "first_seen", "last_visit", "last_successful_visit", "last_time_updated", "status_code", "response_hash", "seq"]
    want = documents.fold(spark.createDataFrame(rows, SCHEMA)).select(*names).collect()
    assert sorted(held.table("documents").select(*names).collect()) == sorted(want)


def test_side_tables_follow_the_documents(spark, taken):
    held, rows = taken
    now = {r.url_id: rows[r.seq] for r in held.table("documents").collect()}
    links = {}
    for url, r in now.items():
        for target, external, text in r[12] or ():
            links.setdefault((url, target), (external, text))
    assert {(r.source_url_id, r.target_url_id): (r.is_external, r.link_text) for r in held.table("links").collect()} == links
    assert {r.url_id: (r.width, r.height, r.image_type) for r in held.table("images").collect()} == {u: r[13][:3] for u, r in now.items() if r[13]}
    latest = {}
    for r in rows:
        if r[10] and (r[9] not in latest or (r[2], r[1]) >= (latest[r[9]][2], latest[r[9]][1])):
            latest[r[9]] = r
    good = {p: r[11] for p, r in latest.items() if r[3] == 20 and r[11] and (p == "/favicon.txt" or "Disallow" in r[11] or "Contact" in r[11])}
    assert {r.path: r.content for r in held.special_files().collect()} == good


def test_work_is_kept_until_done(spark, taken):
    held, rows = taken
    work = {r.url_id: r.work_types for r in held.work().collect()}
    assert set(work) <= set(range(12)) and not set(work) & {0, 1, 2} - {t for r in rows for t, _, _ in r[12] or ()}
    assert all(work[u] & documents.POPULARITY for u in range(3, 12) if any(r[0] == u and r[3] == 20 for r in rows))
    left = store.done(held, spark.createDataFrame([(5,), (6,)], "url_id long"))
    assert {r.url_id for r in left.work().collect()} == set(work) - {5, 6}
    assert left.table("documents").count() == held.table("documents").count()


def test_two_writers(spark, tmp_path):
    path, batch = f"file://{tmp_path}", spark.createDataFrame(responses(5), SCHEMA)
    empty = store.opened(spark, path)
    assert empty.table("links").count() == 0 and empty.work().count() == 0
    store.take(empty, batch, "a", 0)
    with pytest.raises(Exception, match="(?i)exists"):
        store.take(empty, batch, "b", 0)
    same = store.take(store.opened(spark, path), batch.limit(0).withColumn("seq", F.col("seq")), "a", 1)
    assert same.table("documents").count() == store.opened(spark, path).table("documents").count() and same.version == 1
