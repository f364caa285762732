import gzip
import random
import re
from datetime import datetime, timedelta

import pytest
from driftline.functions import parsers, robots
from driftline.operators import archive, crawl, documents, graph, reports, rules
from driftline.sources import files, warc
from pyspark.sql import functions as F

T0 = datetime(2023, 1, 1)


def test_robots(spark):
    content = "# c\nUser-agent: a\nUser-agent: B\nDisallow: /x*\nDisallow:\nDisallow: /a*b\nAllow: /\nCrawl-delay: 3\n\nUser-agent: *\nDisallow: private\nnonsense"
    df = spark.createDataFrame([("h", content), ("g", "Disallow: /before-any-agent")], "authority string, content string")
    got = {(r.user_agent, r.path, r.line_number) for r in rules.parse_robots(df).collect()}
    assert got == {("a", "/x", 4), ("b", "/x", 4), ("a", "", 5), ("b", "", 5), ("*", "/private", 11)}
    urls = spark.createDataFrame([("h", "/x1"), ("h", "/private/2"), ("h", "/ok"), ("z", "/x")], "authority string, path string")
    assert {(r.path, r.allowed) for r in rules.robots_allowed(urls, rules.parse_robots(df), "a").collect() if r.authority == "h"} == {("/x1", False), ("/private/2", False), ("/ok", True)}
    report = parsers.robots_report(df.withColumn("status_code", F.lit(20)).withColumn("meta", F.lit("text/plain"))).collect()
    assert {r.authority: ([w.kind for w in r.warnings], [w.line_number for w in r.warnings], len(r.rules), r.valid) for r in report} == {
        "h": (["wildcard", "allow", "crawl-delay", "no_colon"], [6, 7, 8, 12], 5, True), "g": (["no_agent"], [1], 0, False)
    }
    odd = spark.createDataFrame([("n", None), ("e", ""), ("c", "#only\r\n\r\n"), ("o", "User-agent:\nDisallow: **\nFoo: 1\r\nAllow: x\nUser-agent: q\r\nDisallow: a # b")], "authority string, content string")
    assert {(r.authority, r.line_number, r.kind) for r in robots.robots_warnings(odd).collect()} == {("o", 2, "wildcard"), ("o", 3, "unknown"), ("o", 4, "allow")}
    assert [(r.user_agent, r.path) for r in rules.parse_robots(odd).collect()] == [("q", "/a")]
    assert {(r.authority, r.valid) for r in rules.robots_valid(odd).collect()} == {("n", False), ("e", False), ("c", False), ("o", True)}
    assert robots.robots_warnings(odd.limit(0)).count() == 0


def test_many_rules_against_plain(spark):
    """Prefixes of prefixes, rules that spare themselves, rules of all sites: the first one that hits, by scope and number."""
    rnd = random.Random(6)
    lines = ["regex:x{3}$", "regex:^gemini://s9/"]
    for _ in range(400):
        path = "".join(rnd.choice("ab/") for _ in range(rnd.randint(0, 4)))
        lines.append(f"gemini://s{rnd.randrange(4)}/{path}{rnd.choice(['', '', '$', '*' if rnd.random() < 0.05 else ''])}")
    urls = [(f"gemini://s{k}/{''.join(rnd.choice('ab/') for _ in range(rnd.randint(0, 6)))}", f"s{k}") for k in (rnd.randrange(5) for _ in range(300))]
    urls += [("gemini://s1/xxx", "s1"), ("gemini://s9/a", "s9"), (None, "s1"), ("gemini://s1/ab", None)] + urls[:20]
    parsed = rules.parse_block_rules(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string"))

    def hits(line, url, site):
        if line.startswith("regex:"):
            return re.search(line[6:], url) is not None
        pattern = line.rstrip("*$")
        return (line.endswith("*") or site == pattern.split("/")[2]) and url.startswith(pattern) and (not line.endswith("$") or url != pattern)

    def first(url, site):
        found = [(not (x.startswith("regex:") or x.endswith("*")), n) for n, x in enumerate(lines) if url is not None and hits(x, url, site)]
        return lines[min(found)[1]] if found else None

    df = spark.createDataFrame(urls, "url string, authority string")
    got = sorted(((r.url, r.authority, r.blocked_by) for r in rules.blocked_by(df, parsed).collect()), key=str)
    assert got == sorted(((u, a, first(u, a)) for u, a in urls), key=str)
    assert {r.blocked_by for r in rules.blocked_by(df, parsed.limit(0)).collect()} == {None}
    plan = rules.blocked_by(df, parsed)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # no array of rules


def test_paths_of_many_rules(spark):
    rnd = random.Random(8)
    denied = [(f"h{rnd.randrange(3)}", rnd.choice(["*", "a", "b"]), "".join(rnd.choice("/xy") for _ in range(rnd.randint(0, 4)))) for _ in range(80)]
    urls = [(f"h{rnd.randrange(4)}", "".join(rnd.choice("/xy") for _ in range(rnd.randint(0, 6)))) for _ in range(200)] + [("h0", None), (None, "/x")]
    df, said = spark.createDataFrame(urls, "authority string, path string"), spark.createDataFrame(denied, "authority string, user_agent string, path string")
    got = sorted(((r.authority, r.path, r.allowed) for r in rules.robots_allowed(df, said, "A").collect()), key=str)
    want = [(h, p, not any(h == s and g in ("*", "a") and d and p is not None and p.startswith(d) for s, g, d in denied)) for h, p in urls]
    assert got == sorted(want, key=str)
    assert all(r.allowed for r in rules.robots_allowed(df, said.limit(0), "a").collect())


def test_seen_digests(spark):
    rows = [(1, "a"), (2, None), (3, "a"), (4, None), (5, "b"), (3, "a")]
    df = spark.createDataFrame(rows, "seq long, data_hash string").withColumn("is_proactive", F.lit(False))
    assert sorted((r.seq, r.data_hash, r.seen) for r in rules.content_seen(df, "data_hash", "seq").collect() if r.data_hash) == [(1, "a", False), (3, "a", True), (3, "a", True), (5, "b", False)]
    assert sorted(r.seq for r in crawl.followed(df).collect()) == [1, 2, 4, 5]


def test_block_rules(spark):
    lines = spark.createDataFrame(list(enumerate(["", "# no", "gemini://a/x", "gemini://b/y$", "gemini://c/z*", "regex:\\.zip$"])), "line_no int, line string")
    parsed = rules.parse_block_rules(lines)
    assert [(r.kind, r.authority, r.pattern) for r in parsed.orderBy("rule_no").collect()] == [("prefix", "a", "gemini://a/x"), ("nosub", "b", "gemini://b/y"), ("global", None, "gemini://c/z"), ("regex", None, "\\.zip$")]
    urls = spark.createDataFrame([("gemini://a/x1", "a"), ("gemini://b/y", "b"), ("gemini://b/y/2", "b"), ("gemini://c/zz", "c"), ("gemini://a/q.zip", "a"), ("gemini://a/ok", "a")], "url string, authority string")
    got = {r.url: r.blocked_by for r in rules.blocked_by(urls, parsed).collect()}
    assert got == {"gemini://a/x1": "gemini://a/x", "gemini://b/y": None, "gemini://b/y/2": "gemini://b/y$", "gemini://c/zz": "gemini://c/z*", "gemini://a/q.zip": "regex:\\.zip$", "gemini://a/ok": None}


def fold(spark, steps):
    rows = [(1, n, T0 + timedelta(hours=h), s, d, True) for n, (h, s, d) in enumerate(steps)]
    return documents.fold(spark.createDataFrame(rows, "url_id long, seq long, received timestamp, status_code int, response_hash string, is_text boolean")).first()


@pytest.mark.parametrize(
    ("steps", "first", "last", "updated", "action"),
    [
        ([(5, 20, "a")], 5, 5, 5, "AddCurrent"),
        ([(5, 20, "a"), (5, 20, "b")], 5, 5, 5, "AddCurrent"),
        ([(5, 20, "a"), (3, 20, "a")], 3, 5, 3, "AddCurrent"),
        ([(5, 20, "a"), (3, 20, "b")], 3, 5, 5, "AddCurrent"),
        ([(5, 20, "a"), (7, 20, "a")], 5, 7, 5, "AddCurrent"),
        ([(5, 20, "a"), (7, 20, "b")], 5, 7, 7, "RefreshWithCurrent"),
        ([(5, 20, "a"), (7, 51, "b")], 5, 7, 7, "DeletePrevious"),
        ([(5, 51, "a")], 5, 5, 5, "Nothing"),
        ([(5, 20, "a"), (7, 20, "b"), (6, 20, "b"), (8, 20, "b")], 5, 8, 6, "RefreshWithCurrent"),
    ],
)
def test_document_state(spark, steps, first, last, updated, action):
    r = fold(spark, steps)
    hours = lambda t: int((t - T0).total_seconds() // 3600)
    assert (hours(r.first_seen), hours(r.last_visit), hours(r.last_time_updated), r.action) == (first, last, updated, action)


def test_ingesting_again_changes_nothing(spark):
    steps = [(5, 20, "a"), (3, 20, "b"), (9, 51, "c"), (12, 20, "d")]
    again = fold(spark, [*steps, steps[-1]])
    assert fold(spark, steps) == again


def test_link_changes_close(spark):
    schema = "source_url_id long, target_url_id long, is_external boolean, link_text string"
    a = spark.createDataFrame([(1, 2, True, "x"), (1, 3, False, "y"), (2, 3, True, None)], schema)
    b = spark.createDataFrame([(1, 2, True, "z"), (1, 4, True, ""), (2, 3, True, None)], schema)
    got = {(r.source_url_id, r.target_url_id): (r.change, r.work) for r in documents.link_changes(a, b).collect()}
    assert got == {(1, 2): ("updated", 3), (1, 3): ("removed", 7), (1, 4): ("added", 7), (2, 3): ("unchanged", 0)}
    assert all(r.change == "unchanged" for r in documents.link_changes(b, b).collect())


def test_archive_limits(spark):
    rows = [(20, "text/plain", 6 << 20, True), (20, "image/png", 6 << 20, False), (20, "image/png", 5, True), (20, "image/png", 5, False), (20, "text/x", 0, False), (31, None, 0, False), (51, "text/x", 5, False), (62, None, 0, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, status_code int, mime_type string, size long, is_body_truncated boolean")
    assert sorted(r.i for r in archive.storable(df).collect()) == [0, 3, 5, 7]
    cut = archive.truncated(spark.createDataFrame([(bytearray(b"abcdef"), False), (bytearray(b"ab"), False), (None, True)], "body binary, is_body_truncated boolean"), 4).collect()
    assert [(None if r.body is None else bytes(r.body), r.is_body_truncated) for r in cut] == [(b"abcd", True), (b"ab", False), (None, True)]


def test_reports(spark):
    docs = spark.createDataFrame([("a", 1, 49), ("a", 1, 20), ("b", 1, 49)], "domain string, port int, status_code int").withColumn("last_visit", F.lit(T0))
    assert tuple(reports.search_statistics(docs).first())[:3] == (1, 3, 1)
    bars = reports.bar_chart(spark.createDataFrame([("x", 4), ("y", 2)], "k string, n int"), "k", "n", 10).orderBy("k").collect()
    assert bars[0].bar.count("█") == 10 and bars[1].bar.count("█") == 5
    pop = graph.popularity(spark.createDataFrame([(1, True), (2, False), (3, True)], "url_id long, is_available boolean"), spark.createDataFrame([(9, 1, True)] * 200 + [(9, 2, True)], "source_url_id long, target_url_id long, is_external boolean"))
    assert {r.url_id: r.popularity_rank for r in pop.collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_warc_round_trip(spark, tmp_path):
    warc.register(spark)
    rows = [
        ("gemini://h/a", T0, 20, "text/gemini; charset=utf-8; lang=en", bytearray(b"# hi\r\nbody"), False, "PEM h", "1.2.3.4", "TLS", None), ("gemini://h/b", T0, 51, "gone", None, False, "PEM h", None, "TLS", None),
        ("gemini://h/c", T0, 20, "image/png", bytearray(b"\x00\xff"), True, None, None, None, "image/png"), ("gemini://i/", T0, 49, "no", None, False, "PEM i", None, None, None),
    ]
    df = spark.createDataFrame(rows, "url string, received timestamp, status_code int, meta string, body binary, is_body_truncated boolean, certificate_pem string, remote_address string, tls_protocol string, mime_type string")
    df.coalesce(1).write.format("warc").mode("append").save(f"file://{tmp_path}/w")
    file = next((tmp_path / "w").glob("*.warc"))
    with file.open("ab") as f:
        f.write(b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut off")
    members = [gzip.compress(x) for x in file.read_bytes().split(b"WARC/1.1") if x]
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.warc.gz").write_bytes(b"".join(gzip.compress(b"WARC/1.1" + gzip.decompress(m)) for m in members) + b"\x1f\x8bbroken")
    for records in (warc.read(spark, f"file://{tmp_path}/w"), warc.read_whole(spark, f"file://{tmp_path}/w"), warc.read(spark, f"file://{tmp_path}/z/a.warc.gz"), warc.read_whole(spark, f"file://{tmp_path}/z")):
        assert [r.record_type for r in records.orderBy("record_no").collect()] == ["request", "response", "metadata", "request", "response", "request", "response", "request", "response", "metadata"]
        got = {r.url: r for r in warc.responses(records).collect()}
        a = got["gemini://h/a"]
        assert (a.status_code, a.mime_type, a.charset, a.language, bytes(a.body), a.is_body_truncated) == (20, "text/gemini", "utf-8", "en", b"# hi\r\nbody", False)
        assert got["gemini://h/b"].mime_type is None and got["gemini://h/c"].is_body_truncated and bytes(got["gemini://h/c"].body) == b"\x00\xff"
        heads = {(r.record_type, r.url): r.headers for r in records.collect()}
        answer, asked, sealed = (heads[k, "gemini://h/a"] for k in ("response", "request", "metadata"))
        assert answer["warc-concurrent-to"] == asked["warc-record-id"] and sealed["warc-refers-to"] == answer["warc-record-id"]
        assert answer["warc-ip-address"] == "1.2.3.4" and answer["warc-protocol"] == "TLS" and "warc-cipher-suite" not in answer and answer["warc-payload-digest"].startswith("sha256:")
        assert heads["response", "gemini://h/c"]["warc-identified-payload-type"] == "image/png" and heads["response", "gemini://h/c"]["warc-truncated"] == "length"
        # the certificate of a site that never answered goes, that of the other stays
        assert sorted((r.record_type, r.url) for r in warc.cleaned(records).where("record_type = 'metadata'").collect()) == [("metadata", "gemini://h/a")]
        assert warc.first_records(records, 2).count() == 2


def test_warc_pieces():
    """However a file's bytes are cut, the records are the same."""
    whole = b"".join(warc.record("response", f"gemini://h/{n}", T0, "x/y", bytes([n]) * n * 7, note="v" * n) for n in range(40))
    want = [(h["warc-target-uri"], b) for h, b in warc.records([whole])]
    assert len(want) == 40
    packed = b"".join(gzip.compress(whole[at : at + 500]) for at in range(0, len(whole), 500))
    for data in (whole, packed):
        for size in (1, 2, 3, 64, 1000, 1 << 20):
            assert [(h["warc-target-uri"], b) for h, b in warc.records(data[i : i + size] for i in range(0, len(data), size))] == want
    assert len(list(warc.records([packed[:-30]]))) == 39 and list(warc.records([])) == [] and list(warc.records([b"x"])) == []


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("2020\t20 text/gemini\t\tgemini://h/\tfile\nx\t51 no\tu\tf\n20\tonly\n")
    (tmp_path / "b.tsv").write_text("20\ttext/gemini\tgemini://h/1\n20\ttext/x\tgemini://h/2\tb\n51\tx\ty\n")
    (tmp_path / "c.tsv").write_text("20\tm\tgemini://h/1\t4\t5\t6\t7\t8\thash1\n20\tm\tgemini://h/2\n")
    (tmp_path / "d.cdx").write_text("k 20200102030405 http://u/ text/html 200 d 5\nk 20200102030405 http://v/ text/html 404 d 5\nshort line\n")
    (tmp_path / "seeds").write_text("gemini://A.b\nnot a url\ngemini://a.b/\n")
    assert [(r.meta, r.url, r.body_name) for r in files.crawl_log_a(spark, str(tmp_path / "a.tsv")).collect()] == [("text/gemini", "gemini://h/", "file")]
    assert [(r.url[-1], r.is_body_truncated) for r in files.crawl_log_b(spark, str(tmp_path / "b.tsv")).orderBy("url").collect()] == [("1", True), ("2", False)]
    blobs = spark.createDataFrame([("hash1", bytearray(b"x"))], "data_hash string, body binary")
    assert sorted((r.url[-1], r.is_body_truncated) for r in files.crawl_log_c(spark, str(tmp_path / "c.tsv"), blobs).collect()) == [("1", False), ("2", True)]
    assert [(str(r.captured), r.url) for r in files.cdx(spark, str(tmp_path / "d.cdx")).collect()] == [("2020-01-02 03:04:05", "http://u/")]
    assert [r.url for r in files.seeds(spark, str(tmp_path / "seeds")).collect()] == ["gemini://a.b/"]
    row = spark.createDataFrame([('[["h"],["a","b"]]', '{"pages":[{"title":"T","description":"D"}]}')], "j string, w string").select(files.json_table(F.col("j")).alias("j"), files.encyclopedia_hits(F.col("w")).alias("w")).first()
    assert row.j == [["a", "b"]] and row.w[0].title == "T"
    files.write_log(spark.createDataFrame([("a\tb", 1)], "x string, n int"), str(tmp_path / "log"))
    files.write_statistics(spark.createDataFrame([(1,)], "n int"), str(tmp_path / "stats"))
    assert spark.read.csv(str(tmp_path / "log"), sep="\t").first()[0] == "a b" and spark.read.json(str(tmp_path / "stats")).first().n == 1
