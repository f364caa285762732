import math
import random
import sqlite3

import pytest
from driftline.functions.stem import term
from driftline.functions.text import snippet
from driftline.operators import fts, index
from driftline.plans.userquery import Page, parse
from pyspark.sql import functions as F

TEXTS = [
    ("Cafés", "cats were running over the hills"), ("two cats", "a cat runs; the café is closed, the cat runs again"), ("three", "Straßen und Wege, cafés and naïve connections"),
    ("running cats", "nothing of that kind, connected or not"), ("five", "dogs sleep here"), (None, None), ("", ""), ("long", "cat run " * 3000),
]
SCHEMA = "url_id long, title string, body string, url string, domain string, path string, file_extension string, external_inbound_links int, popularity_rank double, content_type int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, *r, f"u{i}", "ab"[i % 2], f"/{i}", "gmi", i, 0.1 * i, 1 + i % 4) for i, r in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def built(docs, tmp_path_factory):
    return index.build(docs, f"file://{tmp_path_factory.mktemp('index')}")


@pytest.fixture(scope="module")
def lite():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table fts using fts5(title, body, tokenize='porter')")
    con.executemany("insert into fts(rowid, title, body) values (?, ?, ?)", [(i, *r) for i, r in enumerate(TEXTS)])
    return con


@pytest.mark.parametrize("raw", ["running", "cats", "cafe", '"cat running"', "cat NOT hill", "connecting OR cafés", "naive", "straßen", "cat AND run", '"the cat runs" OR dogs', '("cat run cat" OR hill) NOT closed', "nowhere", '"cat nowhere"'])
def test_ranks_of_sqlite(built, docs, lite, raw):
    want = {i: r for i, r in lite.execute("select rowid, bm25(fts) from fts where body match ?", (raw,))}
    got = {r.url_id: r["rank"] for r in index.matched(built, parse(raw)).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-6, abs_tol=1e-9) for i in got)
    scanned = {r.url_id: r["rank"] for r in fts.matched(docs, parse(raw), stemmed=True).collect()}
    assert scanned.keys() == got.keys() and all(math.isclose(got[i], scanned[i], rel_tol=1e-9) for i in got)
    assert index.result_count(built, parse(raw)).first().n == len(want)


@pytest.mark.parametrize("raw", ['intitle:"cat running"', "intitle:cats site:a", "run site:b filetype:gmi", "inurl:3", "cat intitle:two", "site:a"])
def test_scopes_as_by_scanning(built, docs, raw):
    q = parse(raw)
    got, want = ({r.url_id: r["rank"] for r in f.collect()} for f in (index.matched(built, q), fts.matched(docs, q, stemmed=True)))
    assert got.keys() == want.keys() and all((got[i] is None) == (want[i] is None) and (got[i] is None or math.isclose(got[i], want[i], rel_tol=1e-9)) for i in got)


def test_pages_and_snippets(built, docs):
    q = parse("cats OR dogs")
    for page in (Page(1, 2), Page(2, 2)):
        got, want = ([(r.url_id, r.snippet) for r in f.collect()] for f in (index.text_search(built, q, page, docs), fts.text_search(docs, q, page)))
        assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 2
    assert [(r.url_id, r.snippet) for r in index.text_search(built, parse("site:a")).collect()] == [(6, ""), (4, "dogs sleep her"), (2, TEXTS[2][1][:-1]), (0, TEXTS[0][1][:-1])]


def test_only_asked_rows_are_read(built):
    plan = index.matched(built, parse("cats"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "In(term, [cat])" in plan.replace("EqualTo(term,cat)", "In(term, [cat])") and "body" not in plan


def test_images_join_documents_and_favicons(spark, tmp_path):
    images = spark.createDataFrame([(1, 10, "cat pictures"), (2, 20, "dog"), (3, 30, "cats")], "url_id long, width int, terms string")
    documents = spark.createDataFrame([(n, "gemini", h, 1965, f"u{n}", n, 0.5) for n, h in ((1, "a"), (2, "b"), (4, "a"))], "url_id long, protocol string, domain string, port int, url string, external_inbound_links int, popularity_rank double")
    favicons = spark.createDataFrame([("gemini", "a", 1965, "A"), ("gemini", "a", 1, "X")], "protocol string, domain string, port int, emoji string")
    built = index.build(index.image_pages(images, documents, favicons), f"file://{tmp_path}/images")
    assert [(r.url_id, r.width, r.favicon) for r in index.image_search(built, parse("picture")).collect()] == [(1, 10, "A")]
    assert sorted(map(tuple, index.stored(built, [2, 1, 4], "terms").collect())) == [(1, "cat pictures"), (2, "dog")]
    assert index.result_count(built, parse("cat")).first().n == 1


def test_workload(spark):
    words = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["c"]), (4, [])], "doc_id long, own array<string>")
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["a", "z"]), (4, ["b", "c", "a"])], "item_id long, ws array<string>")
    got = sorted((r.item_id, r.doc_id) for r in fts.matched_workload(asked, words).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 3), (4, 1)]


def test_empty_table(docs, tmp_path):
    built = index.build(docs.limit(0), f"file://{tmp_path}/none")
    assert index.matched(built, parse("cat OR dog")).count() == 0 and index.text_search(built, parse("site:a")).count() == 0


RAWS = ["cat OR hill OR dog", '"cat run" OR new', "new NOT cat"]


def agrees(held, lite, raws=RAWS):
    """Every search of the index gives the matches, ranks and counts of SQLite's."""
    for raw in raws:
        want = {i: r for i, r in lite.execute("select rowid, bm25(fts) from fts where body match ?", (raw,))}
        got = {r.url_id: r["rank"] for r in index.matched(held, parse(raw)).collect()}
        assert got.keys() == want.keys(), raw
        assert all(math.isclose(got[i], want[i], rel_tol=1e-6, abs_tol=1e-9) for i in got), raw
    assert index.result_count(held, parse(raws[0])).first().n == lite.execute("select count(*) from fts where body match ?", (raws[0],)).fetchone()[0]
    n, length = lite.execute("select count(*) from fts").fetchone()[0], sum(len(term_list(x)) for x in lite.execute("select title, body from fts"))
    assert (held.rows, held.terms) == (n, length) and held.pages.count() == n


def term_list(row):
    from driftline.functions.stem import analyzed

    return [w for text in row for w in analyzed(text)]


def told(con, rows):
    for i, action, title, body in rows:
        if action in ("DeletePrevious", "AddCurrent", "RefreshWithCurrent"):
            con.execute("delete from fts where rowid = ?", (i,))
        if action in ("AddCurrent", "RefreshWithCurrent"):
            con.execute("insert into fts(rowid, title, body) values (?, ?, ?)", (i, title, body))


BATCHES = [
    [(0, "DeletePrevious", None, None), (3, "RefreshWithCurrent", "new", "new cat"), (20, "AddCurrent", "t", "a new cat runs on"), (5, "Nothing", "x", "x"), (99, "DeletePrevious", None, None)],
    [(0, "AddCurrent", "back", "back on the hill, cats"), (20, "RefreshWithCurrent", "t", "dogs"), (7, "DeletePrevious", None, None)],
    [(21, "AddCurrent", None, None), (3, "DeletePrevious", None, None), (0, "DeletePrevious", None, None), (22, "AddCurrent", "cat", "gone cat run")],
    [(0, "AddCurrent", "again", "cat cat run new")],
]


def as_actions(spark, rows):
    full = [(i, a, t_, b, f"u{i}", "ab"[i % 2], f"/{i}", "gmi", i, 0.01 * i, 1) for i, a, t_, b in rows]
    return spark.createDataFrame(full, "url_id long, action string, title string, body string, url string, domain string, path string, file_extension string, external_inbound_links int, popularity_rank double, content_type int")


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_updates_as_sqlite(spark, docs, tmp_path):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table fts using fts5(title, body, tokenize='porter')")
    told(con, [(i, "AddCurrent", *r) for i, r in enumerate(TEXTS)])
    path = f"file://{tmp_path}/i"
    first = held = index.build(docs, path)
    agrees(held, con)
    before = index.matched(first, parse("cats")).count()
    for n, rows in enumerate(BATCHES):
        old = files(tmp_path)
        held = index.update(held, as_actions(spark, rows), "crawl", n)
        told(con, rows)
        agrees(held, con)
        now = files(tmp_path)
        assert all(now[p] == t for p, t in old.items())  # nothing is rewritten
        assert index.update(held, as_actions(spark, rows), "crawl", n) is held  # the batch comes again
        assert index.opened(spark, path) == held
    # an older version stays as it was
    assert index.matched(first, parse("cats")).count() == before
    # the last generations as one, then all
    held = index.merge(held, 2)
    assert len(held.generations) == 3 and held.generations[2].hidden > 0
    agrees(held, con)
    held = index.remove(held, spark.createDataFrame([(22,), (1,), (500,)], "url_id long"))
    told(con, [(22, "DeletePrevious", None, None), (1, "DeletePrevious", None, None)])
    agrees(held, con)
    held = index.merge(held)
    assert len(held.generations) == 1 and held.generations[0].hidden == 0 and held.generations[0].rows == held.rows
    agrees(held, con)
    # scopes and pages of what is left
    q = parse("site:a")
    assert {r.url_id for r in index.matched(held, q).collect()} == {i for (i,) in con.execute("select rowid from fts") if i % 2 == 0}
    assert index.vacuum(held) > 0 and {p.name for p in (tmp_path / "i" / "postings").iterdir()} == {f"part={held.generations[0].part}"}
    agrees(index.opened(spark, path), con)


def test_a_stopped_update_is_not_seen(spark, docs, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/i"
    held = index.build(docs, path)
    monkeypatch.setattr(index, "_commit", lambda _: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.update(held, as_actions(spark, BATCHES[0]), "crawl", 0)
    monkeypatch.undo()
    assert index.opened(spark, path) == held and index.matched(held, parse("new")).count() == 0
    after = index.update(index.opened(spark, path), as_actions(spark, BATCHES[0]), "crawl", 0)
    assert {r.url_id for r in index.matched(after, parse("new")).collect()} == {3, 20}
    # of two writers that start from the same version the later one fails
    with pytest.raises(Exception, match="(?i)exists"):
        index.update(held, as_actions(spark, BATCHES[1]), "other", 0)
    assert index.opened(spark, path) == after
    assert index.vacuum(after) == 8  # postings, bounds, pages and ids of two steps


def test_the_greatest_seq_of_a_batch_counts(spark, docs, tmp_path):
    held = index.build(docs, f"file://{tmp_path}/i")
    rows = as_actions(spark, [(4, "DeletePrevious", None, None), (4, "AddCurrent", "t", "fresh words"), (2, "AddCurrent", "t", "fresh"), (2, "DeletePrevious", None, None)])
    held = index.update(held, rows.coalesce(1).withColumn("seq", F.monotonically_increasing_id()))
    assert [r.url_id for r in index.matched(held, parse("fresh")).collect()] == [4] and held.rows == len(TEXTS) - 1


def test_merges_are_few(spark, docs):
    def of(*rows):
        return index.Index(spark, "", 0, tuple(index.Generation(str(k), k, n, 0) for k, n in enumerate(rows)), 0, 0, docs.schema)

    assert [index.due(of(*x)) for x in ((100,), (100, 10), (100, 10, 5), (100, 10, 5, 2), (100, 60, 3), (100, 40, 20, 11), (5, 5))] == [1, 2, 1, 1, 0, 0, 0]


def test_pages_by_bounds(spark, docs, tmp_path, monkeypatch):
    """The pages of single words are those of all hits, whatever blocks, generations and hidden rows there are, and few blocks are
    read for them."""
    monkeypatch.setattr(index, "PER_BLOCK", 8)
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(12)]

    def rows(ids, seed):
        r = random.Random(seed)
        return [(i, "AddCurrent", f"t {r.choice(words)}", " ".join(r.choice(words[: r.choice([3, 6, 12])]) for _ in range(r.choice([1, 5, 30, 80]))), f"u{i % 400:03}", "ab"[i % 2], f"/{i}", "gmi", i, (i * 7 % 100) / 100 if i % 9 else None, 1 + i % 2) for i in ids]

    schema = "url_id long, action string, title string, body string, url string, domain string, path string, file_extension string, external_inbound_links int, popularity_rank double, content_type int"
    held = index.build(spark.createDataFrame(rows(range(900), 1), schema).drop("action"), f"file://{tmp_path}/i")
    assert held.generations[0].blocks == 112

    def same(held):
        shares = []
        for raw in ("w0", "w1 OR w9", "w2 NOT w3", "(w4 OR w5) AND w6 site:a", "w11 OR nowhere inurl:7"):
            q = parse(raw)
            total = fts.total_rank(F.col("rank"), F.col("popularity_rank"), F.col("content_type"))
            every = [(r.url_id, r.total_rank) for r in index.matched(held, q).withColumn("total_rank", total).orderBy("total_rank", "url").collect()]
            for page in (Page(1), Page(2, 7), Page(1, 1)):
                read = []
                got = [(r.url_id, r.total_rank) for r in index.text_search(held, q, page, read=read).collect()]
                assert [t for _, t in got] == [t for _, t in every[page.offset : page.offset + page.size]], raw
                assert set(got) <= set(every)
                shares.append((raw, page.size, read[0]))
        return shares

    shares = same(held)
    assert all(n == 30 for raw, size, (n, _) in shares if raw == "w0" and size == 15)  # of 112
    held = index.update(held, spark.createDataFrame(rows([*range(0, 900, 3), *range(900, 950)], 2), schema))
    held = index.remove(held, spark.createDataFrame([(i,) for i in range(0, 900, 10)], "url_id long"))
    same(held)
    same(index.merge(held, 1))


def test_stream_of_actions(spark, docs, tmp_path):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table fts using fts5(title, body, tokenize='porter')")
    told(con, [(i, "AddCurrent", *r) for i, r in enumerate(TEXTS)])
    path = f"file://{tmp_path}/i"
    index.build(docs, path)
    for rows in BATCHES:
        batch = as_actions(spark, rows)
        batch.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(batch.schema).parquet(f"file://{tmp_path}/in")
        stream.writeStream.foreachBatch(index.taking(path, "crawl")).option("checkpointLocation", f"file://{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
        told(con, rows)
        agrees(index.opened(spark, path), con)


def test_snippets_of_sqlite():
    rnd = random.Random(11)
    words = ["cat", "cats", "running", "run", "dog", "hill", "café", "x", "the", "over", "closed", "nowhere"] + [f"w{k}" for k in range(30)]
    texts = []
    for _ in range(500):
        body = "".join(rnd.choice(words if rnd.random() < 0.5 else words[12:]) + rnd.choice([" "] * 8 + [". ", ": ", ".\n", ", ", " .. ", ".", "  ", "! "]) for _ in range(rnd.choice([0, 1, 3, 10, 19, 20, 21, 25, 60, 200])))
        texts.append(rnd.choice(["", " ", "- "]) + body)
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(title, body, tokenize='porter')")
    con.executemany("insert into f(rowid, title, body) values (?, 't', ?)", list(enumerate(texts)))
    compared = 0
    for raw in ("cat", "cats OR dog", "cat AND run", '"cat run"', '"the cat" OR hill OR dog', "cat NOT dog", "(cat OR hill) AND x", '"cat cat"', "cat OR cats"):
        phrases = [tuple(term(w) for w in p.words) for p in parse(raw).phrases]
        for i, want in con.execute("select rowid, snippet(f, 1, '[', ']', '…', 20) from f where f match ?", (f"body: ({raw})",)):
            assert snippet(texts[i], phrases, 20, term) == want
            compared += 1
    assert compared > 1000


def test_snippets_of_a_page(built, docs, lite):
    got = {r.url_id: r.snippet for r in index.text_search(built, parse("cats OR dogs"), texts=docs).collect()}
    want = dict(lite.execute("select rowid, snippet(fts, 1, '[', ']', '…', 20) from fts where body match 'cats OR dogs'"))
    assert got == want and len(got) == 4


def test_count_reads_postings_alone(built):
    plan = index.result_count(built, parse("cats"))._jdf.queryExecution().toString()
    assert "/pages" not in plan and "Python" not in plan


def test_postings_are_not_shuffled(spark, docs, tmp_path, monkeypatch):
    """Texts are dealt to the tasks that split them; what they make is written there, in a merge too."""
    plans, write = [], index._write_postings

    def seen(rows, *rest):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(rows, *rest)

    monkeypatch.setattr(index, "_write_postings", seen)
    held = index.build(docs, f"file://{tmp_path}/i")
    held = index.update(held, as_actions(spark, [(30, "AddCurrent", "t", "all new")]))
    assert held.generations[1].hidden == 0  # nothing was there under its id
    index.merge(held)
    assert len(plans) == 3 and "Exchange" not in plans[2] and all("Exchange" not in p.split("MapInArrow")[0] for p in plans)
